"""Scalar text functions as Column expressions; all offsets count code points from 0, half-open."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import EDGE_CHARS, FLAGS, Lexicon


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once for the row, however often ``use`` (or a lambda in it) refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(s: Column) -> Column:
    """White space runs as one space, trimmed; single spaces, which are most runs, stay as they are."""
    return F.trim(F.regexp_replace(s, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def normalize_for_match(s: Column, drop_diacritics: bool = False) -> Column:
    """Trimmed, lower-cased, white space collapsed; optionally without diacritics."""
    out = squeeze(F.lower(s))
    return strip_diacritics(out) if drop_diacritics else out


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    """Base letters: canonical decomposition less its marks; đ has none and becomes d."""

    def plain(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x
        out = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))
        return out.replace("đ", "d").replace("Đ", "D")

    return s.map(plain)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def words(s: Column) -> Column:
    """Words of the normalised text; empty for an empty text."""
    return F.filter(F.split(normalize_for_match(s), " "), lambda w: w != "")


def word_tokens(s: Column) -> Column:
    """All runs of word characters, lower-cased (of composed text)."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0))


def edge_trim(s: Column, start: Column) -> Column:
    """struct(start, end): bounds of ``s`` (which begins at ``start``) without what clings to its ends."""
    chars = F.lit(EDGE_CHARS)
    lead = F.length(s) - F.length(F.ltrim(s, chars))
    kept = F.length(F.trim(s, chars))
    return F.struct((start + lead).cast("int").alias("start"), (start + lead + kept).cast("int").alias("end"))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull of two intervals; 0 if either is malformed."""
    inter = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    bad = (e1 < s1) | (e2 < s2) | (hull <= 0)
    return F.when(bad, F.lit(0.0)).otherwise(inter / F.when(hull <= 0, 1).otherwise(hull))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(both == 0, 1).otherwise(both))


def head_token(norm: Column) -> Column:
    """The first run of two or more Latin letters; null if there is none."""
    found = F.regexp_extract(norm, r"(?iu)[a-zà-ỹ]{2,}", 0)
    return F.when(found != "", found)


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array in order (joined by spaces); none if it is shorter."""

    def use(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bind(tokens, use)


def word_trigrams(s: Column) -> Column:
    """Distinct word trigrams; a text of one or two words is one short gram, an empty one none."""
    return bind(words(s), lambda w: F.when((F.size(w) > 0) & (F.size(w) < 3), F.array(F.array_join(w, " "))).otherwise(F.array_distinct(ngrams(w, 3))))


def find_flexible(s: Column, needle: Column, hint: Column) -> Column:
    """Start of ``needle`` in ``s``: from ``hint``, else anywhere, else with any white space for its spaces; -1 if none."""
    from_hint = F.call_function("locate", needle, s, hint + 1)
    anywhere = F.call_function("locate", needle, s)
    loose = F.regexp_replace(F.regexp_replace(needle, r"([\\\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    # A regular expression gives no code point offset; what stands before its first match does.
    found = F.call_function("regexp_substr", s, loose)
    return F.when(from_hint > 0, from_hint - 1).when(anywhere > 0, anywhere - 1).when(found.isNotNull(), F.call_function("locate", found, s) - 1).otherwise(-1)


def trim_parenthesis(s: Column, lexicon: Lexicon) -> Column:
    """Cuts a last parenthesis that is never closed, or whose inside tells an event; never to nothing."""
    head = F.regexp_extract(s, r"(?s)^(.*)\(", 1)
    inside = F.regexp_extract(s, r"(?s)\(([^(]*)\)[^()]*$", 1)
    after = F.regexp_extract(s, r"(?s)^.*\(([^(]*)$", 1)
    is_open = F.contains(s, F.lit("(")) & ~F.contains(after, F.lit(")"))
    cut = is_open | (F.contains(s, F.lit("(")) & inside.rlike(FLAGS + lexicon.narrative))
    short = F.rtrim(head, F.lit(" \t"))
    return F.when(cut & (short != ""), short).otherwise(s)


def trim_at_parenthesis(s: Column) -> Column:
    """What stands before the first parenthesis, unless that is first of all."""
    return F.trim(F.when(F.instr(s, "(") > 1, F.substring_index(s, "(", 1)).otherwise(s))


def is_garbage(s: Column, is_result: Column, lexicon: Lexicon) -> Column:
    """Shorter than two characters, a stop span, or (unless a result) only digits and punctuation."""
    t = F.trim(s)
    return (F.length(t) < 2) | normalize_for_match(t).isin(*lexicon.stop_spans) | (~is_result & t.rlike(r"(?U)^[\d\W]+$"))


def too_long(s: Column, most: int = 10) -> Column:
    return F.size(words(s)) > most


def header_of(line: Column, lexicon: Lexicon) -> Column:
    """struct(top, sub) of the first header pattern found in the normalised line; null if none."""
    norm, out = normalize_for_match(line), F.lit(None).cast("struct<top:string,sub:string>")
    for pattern, top, sub in reversed(lexicon.headers):
        value = F.struct(F.lit(top).cast("string").alias("top"), F.lit(sub).cast("string").alias("sub"))
        out = F.when(norm.rlike(FLAGS + pattern), value).otherwise(out)
    return out


def label_of(line: Column, lexicon: Lexicon) -> Column:
    """The label of a ``label: value`` line; null if it has none."""
    found = F.regexp_extract(line, FLAGS + lexicon.label, 1)
    return F.when(found != "", found)


def label_length(line: Column, lexicon: Lexicon) -> Column:
    return F.length(F.regexp_extract(line, FLAGS + lexicon.label, 0))


def looks_like_drug(s: Column, vocabulary_hit: Column, lexicon: Lexicon) -> Column:
    """A route, or a word of the drug vocabulary, and no lab keyword."""
    return ~s.rlike(FLAGS + lexicon.lab) & (s.rlike(FLAGS + lexicon.route) | vocabulary_hit)


def mark_context(text: Column, start: Column, end: Column, before: int = 180, after: int = 80) -> Column:
    """The text around a span, cut at spaces, with the span between [ENT] and [/ENT]."""
    low, high = F.greatest(start - before, F.lit(0)), F.least(end + after, F.length(text))
    left, right = F.substring(text, low + 1, start - low), F.substring(text, end + 1, high - end)
    # What is left of a cut word goes: up to the first space on the left, from the last on the right.
    left = F.when((low > 0) & (F.instr(left, " ") > 0), F.regexp_replace(left, r"(?s)^[^ ]* ", "")).otherwise(left)
    right = F.when((high < F.length(text)) & (F.instr(right, " ") > 0), F.regexp_replace(right, r"(?s) [^ ]*$", "")).otherwise(right)
    return F.concat(left, F.lit(" [ENT] "), F.substring(text, start + 1, end - start), F.lit(" [/ENT] "), right)


def multi_hot(labels: Column, order: tuple[str, ...]) -> Column:
    return F.array(*[F.array_contains(labels, x).cast("double") for x in order])


def labels_over(scores: Column, order: tuple[str, ...], bar: float = 0.5) -> Column:
    """Names of the scores at or over the bar, in order."""
    return F.filter(F.array(*[F.when(scores[k] >= bar, F.lit(x)) for k, x in enumerate(order)]), lambda x: x.isNotNull())


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, or a where b is 0."""
    return a / F.when(b == 0, 1).otherwise(b)


def blank_spans(text: Column, spans: Column) -> Column:
    """Each span of array<struct<start, end, type>> replaced by ``{TYPE}``, from the last to the first."""
    ordered = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))))
    return F.aggregate(ordered, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.lit("{"), s["type"], F.lit("}"), F.substring(acc, s["end"] + 1, F.length(acc))))


def residual_words(template: Column) -> Column:
    """Words left after the slots are taken out."""
    return F.size(words(F.regexp_replace(template, r"\{[^}]*\}", " ")))


def forced_label(template: Column, lexicon: Lexicon) -> Column:
    """The label that a template's own cues demand, if any."""
    clean = F.regexp_replace(template, FLAGS + lexicon.negation_false, " ")
    return F.when(clean.rlike(FLAGS + lexicon.negation), "isNegated").when(template.rlike(FLAGS + lexicon.history), "isHistorical")


def is_natural_name(s: Column, most: int = 6) -> Column:
    """Names that people write: short, without brackets, daggers or codes."""
    return (F.size(words(s)) <= most) & ~s.rlike(r"[\[\](){}†*]|[A-Z]\d{2}")


def clean_generated(s: Column) -> Column:
    """Without a code fence or a lead-in line; null if it holds CJK, Kana or Hangul letters."""
    body = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)^\s*```\w*\n?|\n?```\s*$", ""), r"(?i)^\s*(here is|sure|dưới đây)[^\n]*:\s*\n", ""))
    return F.when(~body.rlike(r"[぀-ヿ㐀-䶿一-鿿가-힯]"), body)


def encode_tags(words_: Column, tags: Column) -> Column:
    """``tag* word tag*`` for each word, joined by spaces."""
    return F.array_join(F.zip_with(words_, tags, lambda w, t: F.concat(t, F.lit("* "), w, F.lit(" "), t, F.lit("*"))), " ")


def decode_tags(encoded: Column, dummy: str = "0") -> Column:
    """array<struct<word, tag>> of an encoded text; a word whose tags don't agree has the dummy tag."""
    triples = F.regexp_extract_all(encoded, F.lit(r"(\S+)\* (\S+) (\S+)\*"), F.lit(0))

    def one(x: Column) -> Column:
        # Neither word nor tag holds a space, so a triple is what two spaces part.
        a, b = F.substring_index(x, " ", 1), F.substring_index(x, " ", -1)
        word = F.substring_index(F.substring_index(x, " ", 2), " ", -1)
        return F.struct(word.alias("word"), F.when(a == b, F.substring(a, F.lit(1), F.length(a) - 1)).otherwise(F.lit(dummy)).alias("tag"))

    return F.transform(triples, one)


def describe_concept(name: Column, synonyms: Column, group: Column, block: Column, chapter: Column, english: Column) -> Column:
    """``name (also: synonyms) group, block, chapter. English``; empty parts are left out."""
    also = F.when(F.size(synonyms) > 0, F.concat(F.lit("(also: "), F.array_join(synonyms, ", "), F.lit(")")))
    tail = F.when(english != "", english)
    return F.concat_ws(". ", F.concat_ws(" ", name, also, F.concat_ws(", ", *[F.when(c != "", c) for c in (group, block, chapter)])), tail)


SNAP_WORD = re.compile(r"[0-9A-Za-zÀ-ỹ]")
NEAR = 64


def snap_to_words(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) widened to whole words, over a decimal point too, then trimmed of white space.

    The tails on both sides are found by a regular expression on the ``NEAR`` characters that stand before and after; only
    where such a tail may be longer are the whole sides read.
    """
    word = "[0-9A-Za-zÀ-ỹ]"
    inside = F.substring(text, start + 1, end - start)
    left = F.length(inside) - F.length(F.regexp_replace(inside, r"(?U)^\s+", ""))
    right = F.length(inside) - F.length(F.regexp_replace(inside, r"(?U)\s+$", ""))

    def lead(before: Column) -> Column:
        tail = lambda p: F.length(F.regexp_extract(before, p, 0))
        return F.when(inside.rlike(r"^[0-9]") & before.rlike(r"[0-9][.,]$"), tail(rf"(?:{word}|(?<=[0-9])[.,](?=[0-9]|$))*$")).when(inside.rlike(rf"^{word}"), tail(rf"(?:{word}|(?<=[0-9])[.,](?=[0-9]))*$")).otherwise(0)

    def trail(after: Column) -> Column:
        tail = lambda p: F.length(F.regexp_extract(after, p, 0))
        return F.when(inside.rlike(r"[0-9]$") & after.rlike(r"^[.,][0-9]"), tail(rf"^[.,][0-9](?:{word}|(?<=[0-9])[.,](?=[0-9]))*")).when(inside.rlike(rf"{word}$"), tail(rf"^(?:{word}|(?<=[0-9])[.,](?=[0-9]))*")).otherwise(0)

    # A match that ends two characters off the cut hasn't seen it: the pattern looks one character on.
    first = F.greatest(start - NEAR, F.lit(0))
    near_lead, near_trail = lead(F.substring(text, first + 1, start - first)), trail(F.substring(text, end + 1, F.lit(NEAR)))
    whole = lambda found, full: bind(found, lambda n: F.when(n < NEAR - 2, n).otherwise(full))
    lead_, trail_ = whole(near_lead, lead(F.substring(text, F.lit(1), start))), whole(near_trail, trail(F.substring(text, end + 1, F.length(text))))

    def bounds(n: Column) -> Column:
        s, e = start - n["lead"] + F.when(n["lead"] == 0, left).otherwise(0), end + n["trail"] - F.when(n["trail"] == 0, right).otherwise(0)
        return F.struct(s.cast("int").alias("start"), F.greatest(s, e).cast("int").alias("end"))

    return bind(F.struct(lead_.alias("lead"), trail_.alias("trail")), bounds)
