"""Operators that keep a table's columns, over rows and columns of all kinds."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import bpe, exact_dedup, jaccard_join, language_id, licenses, mixing, pii, token_counts

LONG = "the house and the dog walk over the green hill " * 22_000
ROWS = [(1, None, "s"), (2, "", "s"), (3, LONG, "s"), (4, "Released under the MIT License", None), (4, "Released under the MIT License", None), (None, "call (212) 555-0147 now", "t"), (6, "tie", "t"), (7, "tie", "t")]
SAMPLES = (("de", "das Haus und der Hund und die Katze " * 5), ("en", "the house and the dog and a cat " * 5))
#: Each operator, and the columns of the table that it replaces.
OPERATORS = {
    "language": (lambda d: language_id.identify(d, SAMPLES), {"Score"}),
    "licences": (lambda d: licenses.scan(d), {"LABELS", "Score"}),
    "bpe": (lambda d: bpe.encode_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken")), set()),
    "tokens": (lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")), set()),
    "pii": (lambda d: pii.find(d), {"pii"}),
    "mix": (lambda d: mixing.mix(d, {"s": 1.0, "t": 1.0}, rows=60), {"Copy"}),
    "exact": (lambda d: exact_dedup.keep_first(d), set()),
}
EXTRA = ["a.b", "LABELS", "Score", "Copy", "pii", "words", "hits", "row", "c0", "n0", "ls_words", "mix_n", "xd_rank", "sig"]


@pytest.fixture(scope="module")
def table(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return d.select("*", *[F.lit(f"mine {c}").alias(c) for c in EXTRA])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_and_rows(table, name):
    run, replaced = OPERATORS[name]
    out = run(table)
    kept = [c for c in table.columns if c not in replaced]
    assert [c for c in out.columns if c in kept] == kept
    rows = out.select(*[F.col(f"`{c}`") for c in kept]).collect()
    assert all(r[c] == f"mine {c}" for r in rows for c in EXTRA if c in kept)
    if name not in ("mix", "exact"):
        assert sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in rows) == sorted((i or 0, t or "", s or "") for i, t, s in ROWS)
    if name == "exact":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 3, 4, 6]
    assert run(table.where("false")).count() == 0


def test_results_of_unusual_rows(table):
    got = {r["doc_id"]: r for r in licenses.scan(table).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[3].n_words == 220_000 and got[4].labels == "mit" and got[6].labels == ""
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(table, SAMPLES).collect() if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "en"}
    assert {r["doc_id"]: [s.kind for s in r["pii"]] for r in pii.find(table).collect()}[None] == ["phone"]
    joined = {r.doc_id: r.component_id for r in jaccard_join.join_similar(table).collect()}
    assert joined == {1: 1, 2: 2, 3: 3, 4: 4, None: None, 6: 6, 7: 6}
    kept = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.annotate(table).collect()}
    assert kept[1] == kept[2] == (1, 2) and kept[7] == (6, 2) and kept[4] == (4, 2)
