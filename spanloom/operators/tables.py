"""Table functions: one class a fold that goes through a document's rows in order.

Each takes a table argument whose partitions are documents (``PARTITION BY doc_id``) and whose order puts the
text first, so that a text travels once however many rows ask about it.  They are called from SQL (see
:mod:`spanloom.plans.sql`) and from the DataFrame operators alike.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sweep import Places

_LONG = T.LongType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


#: What stands at the ends of an item and doesn't belong to it (fixed values).
ITEM_EDGES = " \t.-*+•"


@F.udtf(returnType=_fields(doc_id=_LONG, line_no=T.IntegerType(), start=_LONG, end=_LONG, item=T.StringType()))
class SplitItems:
    """Items of a line (doc_id, line_no, start, line): what commas and semicolons part, without bullets at its ends."""

    def eval(self, row):
        if row["line"] is None:
            return
        for m in re.finditer(r"[^,;]+", row["line"]):
            own = m.group().lstrip(ITEM_EDGES)
            start, item = row["start"] + m.end() - len(own), own.rstrip(ITEM_EDGES)
            if item.strip(" "):
                yield row["doc_id"], row["line_no"], start, start + len(item), item


@F.udtf(returnType=_fields(doc_id=_LONG, k=_LONG, start=_LONG, end=_LONG, error=T.BooleanType()))
class LocateInOrder:
    """Places of a document's items (doc_id, k, item, after, occ), found from a moving cursor.

    The document's text comes first, as a row whose k is null.  An item is looked for behind the one before, or
    behind the first place of ``after`` if that is in the text, and if it isn't found there, in the whole text.
    ``occ`` takes the n-th occurrence in the whole text instead.  Only what is found moves the cursor.
    """

    def __init__(self):
        self.text, self.cursor = "", 0

    def eval(self, row):
        if row["k"] is None:
            self.text = row["text"] or ""
            return
        item, start, at = row["item"] or "", self.cursor, -1
        if row["after"]:
            anchor = self.text.find(row["after"])
            start = anchor + len(row["after"]) if anchor >= 0 else start
        if row["occ"]:
            for _ in range(int(row["occ"])):
                at = self.text.find(item, at + 1)
                if at < 0:
                    break
        else:
            at = self.text.find(item, start)
            if at < 0:
                at = self.text.find(item)
        if at >= 0:
            self.cursor = at + len(item)
        yield row["doc_id"], row["k"], at, at + len(item) if at >= 0 else -1, at < 0


@F.udtf(returnType=_fields(doc_id=_LONG, phrase=T.StringType(), start=_LONG, end=_LONG))
class PlaceLongestFirst:
    """Places of a document's planned phrases (doc_id, phrase), longest first, each where it first fits beside the others.

    The document's text comes first, as a row whose phrase is null; phrases follow by falling length.  A document
    where fewer than ``least`` of its phrases are found gives none.
    """

    def __init__(self):
        self.text, self.n, self.found, self.places, self.doc, self.least = "", 0, [], Places(), None, 0.6

    def eval(self, row, least=0.6):
        self.doc, self.least = row["doc_id"], float(least)
        if row["phrase"] is None:
            self.text = (row["text"] or "").lower()
            return
        self.n += 1
        low = row["phrase"].lower()
        at = self.text.find(low)
        while at >= 0 and not self.places.free(at, at + len(low)):
            at = self.text.find(low, at + 1)
        if at >= 0:
            self.places.take(at, at + len(low))
            self.found.append((self.doc, row["phrase"], at, at + len(low)))

    def terminate(self):
        if len(self.found) >= self.least * self.n:
            yield from sorted(self.found, key=lambda x: x[2])


@F.udtf(returnType=_fields(doc_id=_LONG, start=_LONG, end=_LONG, text=T.StringType(), type=T.StringType(), stage=T.IntegerType()))
class TakeFree:
    """Of a document's ordered candidates (doc_id, stage, start, end, text, type) those that are free; stage 0 is occupied."""

    def __init__(self):
        self.places = Places()

    def eval(self, row):
        if row["stage"] == 0 or self.places.free(row["start"], row["end"]):
            self.places.take(row["start"], row["end"])
            if row["stage"]:
                yield row["doc_id"], row["start"], row["end"], row["text"], row["type"], row["stage"]
