"""Queries on training data (problems 2, 3, 6, 7 and 8)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import mixing, overlap, skeleton, tokenize
from loomspan.llm.topn import latest_rows, top_n
from loomspan.plans.registry import Registry
from loomspan.session import written
from loomspan.sources.tables import table

R = Registry()

#: depth_median_big of a submission whose depth wasn't measured.
NOT_MEASURED = 16777215

P2_SQL = """
with last as (
  select attempt_id, pid, status, itrs_median_big i, depth_median_big d from state where attempt_id is not null
  qualify row_number() over (partition by attempt_id order by loaded_at desc nulls last, row_id desc) = 1),
good as (
  select * from last where lower(trim(status, E' \\t\\r\\n\u00a0\u3000')) = 'pass' and i is not null and d is not null and d <> 16777215
  and pid in (select pid from results where pid is not null))
select pid, cast(row_number() over (partition by pid order by i, d, attempt_id) as int) rank_no, attempt_id from good
qualify row_number() over (partition by pid order by i, d, attempt_id) <= 5
"""


def best_attempts(state: DataFrame, n: int, pids: DataFrame | None = None) -> DataFrame:
    """(pid, rank_no, attempt_id): the n best measured passes of each task id, of each attempt its latest row; ties of loaded_at go to the larger row_id.

    pids (pid): the task ids that are asked for; others leave once an attempt's latest row is known, before any heap.
    """
    measured = F.col("itrs_median_big").isNotNull() & F.col("depth_median_big").isNotNull() & (F.col("depth_median_big") != NOT_MEASURED)
    counts = (overlap.plain_name(F.col("status")) == "pass") & measured
    kept = [F.when(counts, F.col("pid")).alias("pid"), F.col("itrs_median_big").alias("i"), F.col("depth_median_big").alias("d")]
    rows = latest_rows(state, "attempt_id", ["loaded_at", "row_id"], kept).where("pid is not null")
    if pids is not None:
        rows = rows.join(pids.where("pid is not null").select("pid").distinct(), "pid", "left_semi")
    return top_n(rows, "pid", [F.col("i"), F.col("d")], "attempt_id", n)


@R.query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return best_attempts(table(spark, d, "state"), 5, table(spark, d, "results"))


@R.query("p2_best", P2_SQL.replace("\n  and pid in (select pid from results where pid is not null)", " and pid is not null").replace("<= 5", "<= 20"))
def p2_best(spark: SparkSession, d: str) -> DataFrame:
    return best_attempts(table(spark, d, "state"), 20)


P3_TASKS_SQL = r"""
with n as (
  select rec_id, lower(trim(split, E' \t\r\n 　')) split, 'r' kind, pid from results union all select rec_id, lower(trim(split, E' \t\r\n 　')), 's', pid from build_sft),
t as (
  select rec_id, split, kind, nullif(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_extract(trim(pid), '([^/\\]*)$', 1),
    '\.(hvm|json|jsonl|txt)$', '', 'i')), '[^\p{L}\p{N}]+', '_', 'g'), '_'), '(^|_)0+([0-9])', '\1\2', 'g'), '') task from n)
select a.rec_id eval_id, b.rec_id train_id from t a join t b using (task)
where a.kind = 'r' and a.split in ('valid', 'test') and b.kind = 's' and b.split = 'train'
"""


#: Nets by brute force: the tokens of every evaluation net against those of every training net.
P3_NETS_SQL = r"""
with k as (select row_number() over () i, rec_id, lower(trim(split, E' \t\r\n 　')) split, nullif(lower(trim(source, E' \t\r\n 　')), '') source, content c from build_sft where content is not null),
f as (select *, regexp_extract_all(c, '(?s)```[^\n]*\n(.*?)(?:```|$)', 1) b from k where split in ('train', 'valid', 'test')),
net as (select i, rec_id, split, source, regexp_replace(lower(case when len(b) > 0 then array_to_string(b, E'\n') when contains(c, '@') then substr(c, instr(c, '@')) else '' end), '(?s)//[^\n]*|/\*.*?(?:\*/|$)|#[^\n]*', ' ', 'g') x from f),
tok as (select i, t, count(*) n from (select i, unnest(regexp_extract_all(x, '[\p{L}\p{N}_]+')) t from net) group by all),
len as (select i, sum(n) n from tok group by i),
bt as (select a.i a, b.i b, sum(least(a.n, b.n)) m from tok a join net p on p.i = a.i and p.split <> 'train' join tok b using (t) join net q on q.i = b.i and q.split = 'train' group by all),
near as (select a, b from bt join len p on p.i = a join len q on q.i = b where m >= 0.8 * greatest(p.n, q.n) - 1e-9),
"""


@R.query("p3_nets", P3_NETS_SQL + "z as (select 1) select p.rec_id as eval_id, q.rec_id as train_id from near join net p on p.i = a join net q on q.i = b")
def p3_nets(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by net alone, all pairs of rows."""
    records = overlap.net_records(table(spark, d, "build_sft"))
    return overlap.net_pairs(records, written(overlap.overlaps(records), "near"))


P3_TASK = P3_TASKS_SQL[P3_TASKS_SQL.index("n as (") : P3_TASKS_SQL.index("\nselect a.rec_id")]
P3_PAIRS = "w as (select a.rec_id eval_id, b.rec_id train_id from t a join t b using (task) where a.kind = 'r' and a.split in ('valid', 'test') and b.kind = 's' and b.split = 'train')"
P3_FOUND_SQL = P3_NETS_SQL + P3_TASK + ", " + P3_PAIRS + """, u as (select p.rec_id eval_id, q.rec_id train_id from near join net p on p.i = a join net q on q.i = b union all select * from w)
select least(eval_id, train_id) as rec_a, greatest(eval_id, train_id) as rec_b from u"""


@R.query("p3_found", P3_FOUND_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split(table(spark, d, "build_sft"), table(spark, d, "results"))
    return pairs.select(F.least("eval_id", "train_id").alias("rec_a"), F.greatest("eval_id", "train_id").alias("rec_b"))


@R.query("p3_tasks", P3_TASKS_SQL)
def p3_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by task id alone."""
    return overlap.task_pairs(table(spark, d, "build_sft"), table(spark, d, "results"))


#: As p3_report, but for the sort 'equal', whose canonical text SQL doesn't build.
P3_REPORT_SQL = P3_NETS_SQL + P3_TASK.replace("select rec_id, lower", "select null source, rec_id, lower", 1).replace("union all select rec_id", "union all select nullif(lower(trim(source, E' \\t\\r\\n\u00a0\u3000')), ''), rec_id").replace("select rec_id, split, kind, nullif", "select row_number() over () i, source, split, kind, nullif") + """,
u as (select 'net' sort, p.split, q.source, p.i a, q.i b from near join net p on p.i = a join net q on q.i = b
 union all select 'task', p.split, q.source, p.i, q.i from t p join t q using (task) where p.kind = 'r' and p.split in ('valid', 'test') and q.kind = 's' and q.split = 'train')
select sort, split, source, count(distinct a) as n_eval, count(distinct b) as n_train, count(*) as n_pairs from u group by all"""


@R.query("p3_report")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "build_sft"), table(spark, d, "results"))


@R.query("p3_overlap_counts", P3_REPORT_SQL)
def p3_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    """The report without the sort 'equal'."""
    return p3_report(spark, d).where("sort <> 'equal'")


@R.query("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return tokenize.encode(documents, ["doc_id"], "text", words=tokenize.frequent_words(documents, "text"))


@R.query("p6_counts")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.count_tokens(table(spark, d, "documents"), ["doc_id"], "text")


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, weight) of documents, counted once and written."""
    rows = documents.select("doc_id", mixing.source_name(F.col("source")).alias("source"), F.length("text").alias("n_chars"), "text")
    counted = tokenize.count_tokens(rows, ["doc_id", "source", "n_chars"], "text")
    weight = F.when(F.col("n_tokens") > 0, mixing.quality(F.col("n_chars"), F.col("n_tokens")))
    return written(counted.select("doc_id", "source", "n_tokens", weight.alias("weight")), "sized")


@R.query("p7_mixed")
def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@R.query("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


#: The SQL's own table of look-alike letters, by the Latin letter; the operator's is not asked.
P8_LETTERS = {
    "a": "аαɑ", "b": "ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհᏂ", "i": "іıɩιᎥ", "j": "јϳյ", "l": "ӏוןا", "n": "пղռח", "o": "оοσօⲟסهہەھჿ", "p": "рρⲣ",
    "q": "ԛզգ", "r": "г", "s": "ѕꜱ", "u": "υս", "v": "ѵνטᴠʋ", "w": "ѡԝɯᴡ", "x": "хꭓ", "y": "уүγყ", "z": "ᴢ", "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ",
    "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІӀΙꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "ԼᏞꓡⳐ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏕᏚꓢ",
    "T": "ТΤᎢꓔⲦ", "U": "Ꮜꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳᏔꓪ", "X": "ХΧꓫⲬꞳ", "Y": "УҮΥᎩᎽꓬⲨ", "Z": "ΖᏃꓜⲌ",
}


def _look_sql() -> str:
    """SQL of the same forms by composed characters, for DuckDB's translate: letters by P8_LETTERS, forms by their compatibility decomposition."""
    pairs = {old: latin for latin, letters in P8_LETTERS.items() for old in letters}
    blank = "".join(chr(c) for first, last in skeleton.NO_WIDTH for c in range(first, last + 1))
    for c in (x for x in range(0x80, 0x20000) if not 0xD800 <= x < 0xE000 and chr(x) not in blank):
        shape, kind = unicodedata.decomposition(chr(c)), unicodedata.category(chr(c))
        to = unicodedata.normalize("NFKC", chr(c))
        if kind == "Zs":
            pairs[chr(c)] = " "
        elif len(to) == 1 and to not in blank and (shape.startswith(("<wide>", "<narrow>", "<font>")) or shape.startswith("<compat>") and kind[0] in "LN" and kind not in ("Lo", "No", "Lm")):
            pairs[chr(c)] = pairs.get(to, to)
    for c in (x for x in range(0xC0, 0x20000) if not 0xD800 <= x < 0xE000):  # letters with accents are one sign in composed texts
        parts = unicodedata.normalize("NFD", chr(c))
        to = unicodedata.normalize("NFC", "".join(pairs.get(x, x) for x in parts))
        if len(parts) > 1 and len(to) == 1 and to != chr(c):
            pairs[chr(c)] = to
    old, new = "".join(pairs), "".join(pairs.values()).replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize(translate(text, '{blank}', '')), '{old}', '{new}'))"


P8_SQL = f"with k as (select doc_id, text, {_look_sql()} look from documents where text is not null)"


@R.query("p8_found", P8_SQL + " select a.doc_id as doc_a, b.doc_id as doc_b from k a join k b using (look) where a.doc_id < b.doc_id and a.text <> b.text")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = skeleton.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


@R.query("p8_forms")
def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return skeleton.skeletons(table(spark, d, "documents"), "doc_id", "text")


@R.query("p8_groups", P8_SQL + ", g as (select look, min(doc_id) group_id, count(*) n_rows, count(distinct text) n_texts from k group by look) select doc_id, group_id, n_rows, n_texts from k join g using (look)")
def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.groups(table(spark, d, "documents"), "doc_id", "text")
