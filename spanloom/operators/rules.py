"""The rule extractor: lines with their section context to typed mentions.

Each line yields mentions by the first of: lab results (a lab section, or a lab keyword with a number), drugs
(a drug section, or what looks like a drug), diagnoses, and symptoms, item by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import DIAGNOSIS, DRUG, FLAGS, LAB_NAME, LAB_RESULT, SYMPTOM, Lexicon
from .lines import lines, matches, sections

LONG_PROSE = 18
_MENTION = "array<struct<start:int,end:int,type:string>>"


def _none() -> Column:
    return F.array().cast(_MENTION)


def _one(bounds: Column, kind: str) -> Column:
    made = F.array(F.struct(bounds["start"].cast("int").alias("start"), bounds["end"].cast("int").alias("end"), F.lit(kind).alias("type")))
    return F.when(bounds["end"] > bounds["start"], made).otherwise(_none())


def _first(content: Column, pattern: str) -> Column:
    """struct(start, text) of the first match; start counts code points."""
    found = F.regexp_extract(content, pattern, 0)
    return F.struct(F.length(F.element_at(F.split(content, pattern, 2), 1)).alias("start"), found.alias("text"))


def lab_mentions(content: Column, base: Column, lexicon: Lexicon) -> Column:
    """The first lab name and the first number, whichever comes first."""
    lab, number = FLAGS + lexicon.lab, lexicon.number
    name, value = _first(content, lab), _first(content, number)
    named = F.when(content.rlike(lab), _one(X.edge_trim(name["text"], base + name["start"]), LAB_NAME)).otherwise(_none())
    start = (base + value["start"]).cast("int")
    valued = F.when(content.rlike(number), F.array(F.struct(start.alias("start"), (start + F.length(value["text"])).cast("int").alias("end"), F.lit(LAB_RESULT).alias("type")))).otherwise(_none())
    return F.concat(named, valued)


def symptom_mentions(content: Column, base: Column) -> Column:
    """Items between commas and semicolons that are neither long nor hold a colon."""
    parts = F.filter(matches(content, "[,;]+|[^,;]+"), lambda m: ~m["match"].rlike("^[,;]"))

    def one(m: Column) -> Column:
        b = X.edge_trim(m["match"], base + m["start"])
        return F.struct(b["start"].cast("int").alias("start"), b["end"].cast("int").alias("end"), F.lit(SYMPTOM).alias("type"))

    good = F.filter(parts, lambda m: ~X.too_long(m["match"]) & ~F.contains(m["match"], F.lit(":")))
    return F.filter(F.transform(good, one), lambda x: x["end"] > x["start"])


def mention_structs(content: Column, base: Column, sub: Column, drug_word: Column, lexicon: Lexicon) -> Column:
    """array<struct<start, end, type>> of one line's content."""
    is_lab = (sub == "lab") | (content.rlike(FLAGS + lexicon.lab) & content.rlike(lexicon.number))
    is_drug = (sub == "drug") | X.looks_like_drug(content, drug_word, lexicon)
    drug_text = X.trim_at_parenthesis(content)
    lead = F.length(content) - F.length(F.ltrim(content))
    drug = F.when((drug_text != "") & ~X.too_long(drug_text), _one(X.edge_trim(drug_text, base + lead), DRUG)).otherwise(_none())
    diagnosis = F.when(~X.too_long(content), _one(X.edge_trim(content, base), DIAGNOSIS)).otherwise(_none())
    return F.when(is_lab, lab_mentions(content, base, lexicon)).when(is_drug, drug).when(sub == "diagnosis", diagnosis).otherwise(symptom_mentions(content, base))


def extract(docs: DataFrame, lexicon: Lexicon, drug_vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, text, type, top, sub, line, line_start): the mentions of every document.

    ``drug_vocabulary(word)`` holds single lower-case words; a line's words of four letters or more meet it in
    a semi-join.
    """
    s = sections(lines(docs), lexicon)
    bare = F.col("header").isNotNull() & F.col("label").isNull()
    cut = F.when(F.col("label").isNotNull(), X.label_length(F.col("line"), lexicon)).otherwise(F.length(F.regexp_extract("line", lexicon.bullet, 0)))
    prose = F.col("label").isNull() & (cut == 0) & (F.size(X.words(F.col("line"))) > LONG_PROSE)
    # Markers go from what is read, not from the coordinates: spans keep their place in the raw text.
    content = F.regexp_replace(F.substring(F.col("line"), cut + 1, F.length("line")), lexicon.markdown, "  ")
    kept = s.where((F.trim("line") != "") & ~bare & ~prose & F.col("sub").isNotNull() & ~F.col("sub").isin(*lexicon.skip_subs))
    kept = kept.withColumns({"content": content, "base": F.col("start") + cut}).where(F.trim("content") != "")
    if drug_vocabulary is None:
        kept = kept.withColumn("drug_word", F.lit(False))
    else:
        words = kept.select("doc_id", "line_no", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"[a-z][a-z\-]{3,}"), F.lit(0))).alias("word"))
        hit = words.join(drug_vocabulary.select("word"), "word", "left_semi").select("doc_id", "line_no").distinct().withColumn("drug_word", F.lit(True))
        kept = kept.join(hit, ["doc_id", "line_no"], "left").fillna(False, ["drug_word"])
    found = mention_structs(F.col("content"), F.col("base").cast("int"), F.col("sub"), F.col("drug_word"), lexicon)
    flat = kept.select("doc_id", "line_no", "line", F.col("start").alias("line_start"), "top", "sub", F.inline(found))
    text = F.substring(F.col("line"), (F.col("start") - F.col("line_start")).cast("int") + 1, F.col("end") - F.col("start"))
    return flat.withColumn("text", text)
