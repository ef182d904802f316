import random
import re
from collections import Counter

import pytest

from loomspan.llm import overlap as O

SFT = "rec_id bigint, split string, source string, pid string, content string, is_train string"
RES = "rec_id bigint, split string, pid string"
NET = "@prog = ( a1 ( b2 c3 ) )\n  & @walk_x ~ ( d4 [ - 3596 ] e5 )\n\n@walk_x = ( f6 ( g7 h8 ) )\n  & $( * 13204913 ) ~ i9 j0\n"


def net_tokens(content):
    """Record by record, as the batch form must give it."""
    net = re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*", " ", O.net_text(content).lower(), flags=re.S)
    return re.findall(r"\w+", net)


def found(spark, sft, res=(), sort="net"):
    pairs = O.cross_split(spark.createDataFrame([(*r, "x") for r in sft], SFT), spark.createDataFrame(list(res), RES))
    return sorted((r.eval_id, r.train_id) for r in pairs.collect() if r.sort == sort)


def test_layouts_of_one_net(spark):
    one, two = NET.strip().split("\n\n")
    forms = [f"```\n{NET}```", f"Here it is:\n\n```hvm\n{two}\n\n{one}\n```\nand more words 1 2 3", NET.replace(" ", "\t").replace("\n", " // note 77\n"), f"```\n{NET}", NET.upper()]
    rows = [(1, "train", "s", "p", f"```\n{NET}```")] + [(10 + i, " TEST", None, None, f) for i, f in enumerate(forms)]
    assert found(spark, rows) == [(10 + i, 1) for i in range(len(forms))]


def test_nothing_without_a_net(spark):
    blank = [None, "", "  \n", "```\n\n```", "```", "only words"]
    assert found(spark, [(i, "train", "s", "p", c) for i, c in enumerate(blank)] + [(10 + i, "test", "s", "p", c) for i, c in enumerate(blank)]) == []
    assert found(spark, []) == []


def test_splits(spark):
    net = f"```\n{NET}```"
    rows = [(1, "Train ", "s", "p", net), (2, "VALID", "s", "p", net), (3, None, "s", "p", net), (4, "other", "s", "p", net), (5, "train", "s", "p", net), (5, "train", "s", "p", net)]
    assert found(spark, rows) == [(2, 1), (2, 5), (2, 5)]


def brute(rows, similarity):
    want = []
    for i, s, _, _, c in rows:
        for j, t, _, _, e in rows:
            a, b = Counter(net_tokens(c)), Counter(net_tokens(e))
            if s == "test" and t == "train" and a and b and sum((a & b).values()) >= similarity * max(sum(a.values()), sum(b.values())) - 1e-9:
                want.append((i, j))
    return sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows, nets = [], []
    for i in range(160):
        if nets and r.random() < 0.6:  # a copy with some tokens changed, near the limit on both sides
            net = list(r.choice(nets))
            for _ in range(r.randint(0, len(net) // 3)):
                net[r.randrange(len(net))] = r.choice(["q", "z9", str(r.randrange(9)), "walk"])
            if r.random() < 0.3:
                net = net[: r.randint(1, len(net))]
        else:
            net = [r.choice(["a", "b", "walk_x", "prog", str(r.randrange(40)), str(r.randrange(10**6))]) for _ in range(r.randint(1, 30))]
        nets.append(net)
        rows.append((i, r.choice(["train", "test"]), "s", "p", "@ " + " ".join(net)))
    for similarity in (0.8, 0.6):
        sft = spark.createDataFrame([(*x, "x") for x in rows], SFT)
        pairs = O.cross_split(sft, spark.createDataFrame([], RES), similarity)
        assert sorted((p.eval_id, p.train_id) for p in pairs.collect()) == brute(rows, similarity)


def test_hot_class_is_whole(spark, monkeypatch):
    monkeypatch.setattr(O, "PAIRS_A_TASK", 100)
    net = f"```\n{NET}```"
    rows = [(i, "train", "s", "p", net) for i in range(60)] + [(1000 + i, "test", "s", "p", net.replace("3596", "3597")) for i in range(40)]
    assert found(spark, rows) == sorted((1000 + j, i) for i in range(60) for j in range(40))


def test_tasks(spark):
    spelt = ["gen_treelap_75", " Gen Treelap 75", "GEN-TREELAP-075", "runs/exp42/nets/gen_treelap_75.hvm", "gen_treelap_7", "gen_treelap_750", None, "", " "]
    res = [(100 + i, "test", p) for i, p in enumerate(spelt)] + [(200, "train", spelt[0]), (201, None, spelt[0])]
    sft = [(1, "train", "s", "Gen_Treelap_75", None), (2, "valid", "s", "gen_treelap_75", None), (3, "train", None, None, None), (4, "train", None, "", None)]
    assert found(spark, sft, res, "task") == [(100, 1), (101, 1), (102, 1), (103, 1)]


def test_long_net(spark):
    net = "@ " + " ".join(f"n{i % 50000}" for i in range(120_000)) + " same" * 70_000
    assert found(spark, [(1, "train", "s", "p", net), (2, "test", "s", "p", net + " more")]) == [(2, 1)]


def test_tokens_of_batches_against_one_by_one():
    r = random.Random(5)
    signs = ["@", "a", "B", "_9", " ", "\n", "=", "//x", "/*", "*/", "#", "é", "中", "\x1e", "²", "(", "walk_1"]
    nets = [O.net_text("@" + "".join(r.choice(signs) for _ in range(r.randint(0, 40)))) for _ in range(300)] + ["", "@", "@a"]
    data, begin, end, row, _ = O.token_spans(nets)
    got = [[] for _ in nets]
    for b, e, i in zip(begin, end, row):
        got[i].append(data[b:e].tobytes().decode())
    assert got == [net_tokens(n) for n in nets]


def test_a_token_that_all_hold_is_split(spark, monkeypatch):
    """Nets of few words of a small vocabulary: every token is hot, and every pair of classes still comes out once."""
    monkeypatch.setattr(O, "PAIRS_A_TASK", 50)
    r = random.Random(3)
    rows = [(i, "train" if i % 2 else "test", "s", "p", "@ " + " ".join(r.choice("abcdefghijklmnopqr") for _ in range(10))) for i in range(240)]
    assert found(spark, rows) == brute(rows, 0.8) != []


def test_hot_training_class(spark, monkeypatch):
    """Several evaluation classes near one class of many copies: its rows are split over tasks."""
    monkeypatch.setattr(O, "PAIRS_A_TASK", 20)
    net = f"```\n{NET}```"
    rows = [(i, "train", "s", "p", net) for i in range(50)] + [(100 + i, "test", "s", "p", net.replace("3596", str(i))) for i in range(12)]
    assert found(spark, rows) == [(100 + j, i) for j in range(12) for i in range(50)]


def test_report(spark):
    net = f"```\n{NET}```"
    swapped = net.replace("b2 c3", "c3 b2")  # the same names and numbers, wired differently
    columns = [(1, "train", "S ", "p_1", net, "x"), (2, "train", None, "p_1", swapped, "x"), (3, "test", "t", "q_1", net, "x"), (4, "TEST", "t", "q_1", net, "x"), (5, "train", "s", None, net.upper(), "x")]
    res = spark.createDataFrame([(9, "valid", "P 1"), (8, "valid", "p-01")], RES)
    got = sorted(map(tuple, O.report(spark.createDataFrame(columns, SFT), res).collect()), key=str)
    want = [("equal", "test", "s", 2, 2, 4), ("net", "test", "s", 2, 2, 4), ("net", "test", None, 2, 1, 2), ("task", "valid", "s", 2, 1, 2), ("task", "valid", None, 2, 1, 2)]
    assert got == sorted(want, key=str)
    assert O.report(spark.createDataFrame([], SFT), spark.createDataFrame([], RES)).collect() == []


def test_definitions_in_any_order_are_equal(spark):
    one, two = NET.strip().split("\n\n")
    rows = [(1, "train", "s", None, f"```\n{one}\n\n{two}\n```", "x"), (2, "test", "s", None, f"```\n{two}\n\n{one}\n```", "x")]
    got = O.report(spark.createDataFrame(rows, SFT), spark.createDataFrame([], RES)).collect()
    assert sorted((r.sort, r.n_pairs) for r in got) == [("equal", 1), ("net", 1)]
