"""The audit of filters against applying every order to every row."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import filter_audit as A

SF = "/root/testdata/sf0.001"


def brute(rows, names):
    """rows: (part, set of failed filters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        share = dict.fromkeys(names, 0)
        for order in permutations(names):
            left = own
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                fails = sum(x in r[1] for r in own)
                out[part, "".join(order), step] = [len(kept), len(gone), fails - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), x]
                share[x] += len(gone)
                left = kept
        for key, v in out.items():
            if key[0] == part:
                v[-1] = share[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def flags_of(docs):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in least and (i is None or least[t] < i)}
        yield i, source or "", {x for x, v in fails.items() if v}


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(part, fails, bool(i in labels and labels[i].quality == 1), bool(i in labels and labels[i].toxic == 1)) for i, part, fails in flags_of(docs)]
    got = A.op11_filter_audit(spark, SF).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == brute(rows, "ABCDE")
    assert len(got) == 600 * len({r[0] for r in rows})


def test_flags_of_unusual_rows(spark):
    long = "Word word $ " * 100_000
    docs = [(1, None, "s"), (2, "", "s"), (None, "", None), (3, long, None), (4, long, ""), (4, long, ""), (5, "Éà " * 60, "t"), (6, "A" * 10 + "b" * 190, "t"), (7, "A" * 11 + "b" * 189, "t"), (8, "tab\x0bsep\x0cone\x1ftwo", "t")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("digest", F.lit("mine")).withColumn("A", F.lit("mine"))
    got = sorted(((r.id or 0), r.part or "", "".join(x for x in "ABCDE" if r[x])) for r in A.text_flags(table).collect())
    assert got == sorted(((i or 0), p, "".join(sorted(f))) for i, p, f in flags_of(docs))
    assert A.text_flags(table.where("false")).count() == 0


@pytest.mark.parametrize("names", ["A", "XY", "ABC", "ABCD"])
def test_any_filters(spark, names):
    rng = np.random.default_rng(len(names))
    rows = [(str(p), *map(bool, m), bool(g)) for p, m, g in zip(rng.integers(0, 3, 200), rng.integers(0, 2, (200, len(names))), rng.integers(0, 2, 200), strict=True)]
    table = spark.createDataFrame(rows, "part string, " + ", ".join(f"f{k} boolean" for k in range(len(names))) + ", good boolean")
    out = A.audit(table, {x: F.when(F.col(f"f{k}"), True) for k, x in enumerate(names)}, F.col("part"), {"g": F.col("good"), "none": F.lit(None).cast("boolean")})
    want = brute([(r[0], {x for x, v in zip(names, r[1:-1], strict=True) if v}, r[-1], False) for r in rows], names)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.g, r.none, r.shapley) for r in out.collect()} == want
    assert A.audit(table.where("false"), {"A": F.lit(True)}, F.col("part"), {}).count() == 0
    with pytest.raises(ValueError):
        A.audit(table, {}, F.col("part"), {})
