"""The lexicon's XML: entities of its document type are expanded, then entries are parsed in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V

_ENTRY = """
ent_seq long,
k_ele array<struct<keb string, ke_inf array<string>, ke_pri array<string>>>,
r_ele array<struct<reb string, re_nokanji string, re_restr array<string>, re_inf array<string>, re_pri array<string>>>,
sense array<struct<stagk array<string>, stagr array<string>, pos array<string>, xref array<string>, ant array<string>, field array<string>, misc array<string>,
  s_inf array<string>, lsource array<struct<_VALUE string, `_xml:lang` string, _ls_type string, _ls_wasei string>>, dial array<string>,
  gloss array<struct<_VALUE string, `_xml:lang` string, _g_type string>>>>
"""
#: The entities that every XML text knows; they must stay escaped until the parser reads them.
_OWN = ("amp", "lt", "gt", "quot", "apos")


def entities(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and texts of the entities that the document type declares; a few hundred at most."""
    lines = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r'(<!ENTITY\s+\S+\s+"[^"]*")'), F.lit(1)).alias("e")).where(F.size("e") > 0)
    found = lines.select(F.explode("e").alias("e")).select(F.regexp_extract("e", r'<!ENTITY\s+(\S+)\s+"([^"]*)"', 1).alias("name"), F.regexp_extract("e", r'"([^"]*)"', 1).alias("text"))
    return {r["name"]: r["text"] for r in found.collect() if r["name"] not in _OWN}


def _expanded(text, names: dict[str, str]):
    """Split at each reference and put the texts in; one pass over the text whatever the number of names."""
    if not names:
        return text
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&[\w.-]+;|[^&]+|&"), F.lit(0))
    escaped = lambda t: F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.array_join(F.transform(parts, lambda t: F.when(F.startswith(t, F.lit("&")), F.coalesce(escaped(F.try_element_at(table, F.substring(t, F.lit(2), F.length(t) - 2))), t)).otherwise(t)), "")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(ent_seq, k_ele, r_ele, senses): one row for each entry of the file.

    The file is cut at the end of entries, so its parts are read in parallel. A sense's language is that of its first gloss: English where
    none is given, ``unk`` where it is not known; each gloss keeps its own type.
    """
    names = entities(spark, path)
    chunks = spark.read.option("lineSep", "</entry>").text(path)
    body = F.regexp_extract("value", r"(?s)<entry>(.*)$", 1)
    # the parser gives attributes of one name only without their prefix
    xml = F.concat(F.lit("<entry>"), F.replace(_expanded(body, names), F.lit("xml:lang="), F.lit("lang=")), F.lit("</entry>"))
    schema = _ENTRY.replace("`_xml:lang`", "_lang").replace("\n", " ")
    parsed = chunks.where(body != "").select(F.from_xml(xml, schema, {"rowTag": "entry"}).alias("e")).select("e.*").where("ent_seq is not null")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    strings = lambda c: empty(c, "array<string>")

    def sense(s):
        gloss = empty(s["gloss"], "array<struct<_VALUE:string,_lang:string,_g_type:string>>")
        source = empty(s["lsource"], "array<struct<_VALUE:string,_lang:string,_ls_type:string,_ls_wasei:string>>")
        return F.struct(
            V.language_of(F.try_element_at(gloss, F.lit(1))["_lang"]).alias("lang"),
            *[strings(s[c]).alias(c) for c in ("stagk", "stagr", "pos", "xref", "ant", "field", "misc", "s_inf", "dial")],
            F.transform(source, lambda x: F.struct(x["_VALUE"].alias("text"), (x["_ls_type"] == "part").eqNullSafe(True).alias("part"), (x["_ls_wasei"] == "y").eqNullSafe(True).alias("wasei"))).alias("lsource"),
            F.transform(gloss, lambda x: x["_VALUE"]).alias("gloss"), F.transform(gloss, lambda x: x["_g_type"]).alias("g_type"),
        )

    return parsed.select(
        "ent_seq",
        F.transform(empty(F.col("k_ele"), "array<struct<keb:string,ke_inf:array<string>,ke_pri:array<string>>>"), lambda k: F.struct(k["keb"].alias("keb"), strings(k["ke_inf"]).alias("ke_inf"), strings(k["ke_pri"]).alias("ke_pri"))).alias("k_ele"),
        F.transform("r_ele", lambda r: F.struct(r["reb"].alias("reb"), r["re_nokanji"].isNotNull().alias("re_nokanji"), strings(r["re_restr"]).alias("re_restr"), strings(r["re_inf"]).alias("re_inf"), strings(r["re_pri"]).alias("re_pri"))).alias("r_ele"),
        F.transform("sense", sense).alias("senses"),
    )
