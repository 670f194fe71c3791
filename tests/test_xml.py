"""A small lexicon with a document type, read from XML and carried through the entry operators."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import lexicon as L
from lexiflow.operators import search as Q
from lexiflow.sources.xml import read_lexicon

XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE JMdict [
<!ENTITY n "noun (common) (futsuumeishi)">
<!ENTITY vs "noun or participle which takes the aux. verb suru">
]>
<JMdict>
<entry><ent_seq>1000</ent_seq><r_ele><reb>ネコ</reb><re_nokanji/></r_ele><r_ele><reb>ねこ</reb></r_ele>
<sense><pos>&n;</pos><xref>犬・いぬ・1</xref><gloss>cat &amp; kitten</gloss><gloss g_type="fig">feline</gloss></sense></entry>
<entry><ent_seq>1010</ent_seq><k_ele><keb>犬</keb><ke_pri>nf07</ke_pri></k_ele><k_ele><keb>狗</keb></k_ele><r_ele><reb>いぬ</reb><re_restr>犬</re_restr></r_ele>
<sense><stagk>狗</stagk><stagr>いぬ</stagr><pos>&n;</pos><pos>&vs;</pos><ant>ネコ</ant><xref>無い</xref><lsource xml:lang="eng" ls_type="part" ls_wasei="y">dog</lsource><gloss>dog</gloss></sense>
<sense><gloss xml:lang="spa">perro</gloss></sense><sense><gloss xml:lang="xyz">?</gloss></sense></entry>
<entry><ent_seq>1020</ent_seq><k_ele><keb>東京</keb></k_ele><r_ele><reb>トウキョウ</reb></r_ele><sense><gloss>Tokyo</gloss></sense></entry>
</JMdict>
"""


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "lexicon.xml"
    path.write_text(XML, encoding="utf-8")
    return read_lexicon(spark, str(path)).cache()


def test_entries(entries):
    rows = {r.ent_seq: r for r in entries.collect()}
    assert sorted(rows) == [1000, 1010, 1020]
    cat, dog = rows[1000], rows[1010]
    assert cat.k_ele == [] and [(r.reb, r.re_nokanji) for r in cat.r_ele] == [("ネコ", True), ("ねこ", False)]
    assert cat.senses[0].pos == ["noun (common) (futsuumeishi)"] and cat.senses[0].gloss == ["cat & kitten", "feline"] and cat.senses[0].g_type == [None, "fig"]
    assert [s.lang for s in dog.senses] == ["en", "es", "unk"]
    source = dog.senses[0].lsource[0]
    assert (source.text, source.part, source.wasei) == ("dog", True, True)


def test_restrictions(entries):
    row = entries.where("ent_seq = 1010").select(
        L.restriction_places(F.col("senses")[0]["stagk"], F.col("k_ele.keb")).alias("k"),
        L.reading_applies(F.col("r_ele")[0]["re_restr"], F.lit("狗")).alias("no"), L.reading_applies(F.col("r_ele")[0]["re_restr"], F.lit("犬")).alias("yes"),
    ).first()
    assert (row.k, row.no, row.yes) == ([1], False, True)


def test_terms_and_references(entries):
    terms = L.terms(entries)
    assert {(r.ent_seq, r.text, r.kind) for r in terms.where("lang = 'jp'").collect()} == {(1000, "ねこ", "reading"), (1010, "犬", "kanji"), (1010, "狗", "kanji"), (1010, "いぬ", "reading"), (1020, "東京", "kanji"), (1020, "とうきょう", "reading")}
    assert {r.common for r in terms.where("ent_seq = 1010").collect()} == {1}
    resolved = L.resolve_references(L.unresolved_references(entries), entries)
    assert {(r.ent_seq, r.kind, r.target_seq) for r in resolved.collect()} == {(1000, "xref", 1010), (1010, "ant", 1000), (1010, "xref", None)}
    heads = {(r.ent_seq, r.kind): r.words for r in L.reference_headwords(resolved, entries).collect()}
    assert heads == {(1000, "xref"): ["犬"], (1010, "ant"): ["ネコ"]}


def test_search(spark, entries):
    queries = Q.rewrite_queries(spark.createDataFrame([(1, "Toukyou"), (2, "neko"), (3, "dog"), (4, "perro"), (5, "ネコ"), (6, "zzz"), (7, "")], "query_id int, q_raw string"))
    hits = Q.search(L.terms(entries), queries).collect()
    assert {(h.query_id, h.ent_seq, h.kind) for h in hits} == {(1, 1020, "reading"), (2, 1000, "reading"), (3, 1010, "gloss"), (4, 1010, "gloss"), (5, 1000, "reading")}
    scores = {h.query_id: h.score for h in hits}
    assert scores[5] == 128 + 64 + 62 and scores[3] == 128 + 62 + 1
