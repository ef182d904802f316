from loomspan.plans import expressions, graphs, nested_files, reconciliation, rules, sequences, trees

CORE = [nested_files.R, sequences.R, graphs.R, reconciliation.R, trees.R, expressions.R, rules.R]
