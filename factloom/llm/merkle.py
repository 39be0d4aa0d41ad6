"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text.

Pieces (up to eight words that end with a sentence, at most 40 code points a word) cover a
paragraph, paragraphs (lines) cover the text, and a section is a run of paragraphs up to a
blank one or one whose digest begins with zero, so borders move with the content and an
insertion changes only the branches it touches.  Every node is the SHA-256 of the nodes
below it.  Equal roots mean equal texts; branches that differ locate an edit.

Everything here is a column expression or a DataFrame of built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole

_S, _W, _I = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?]"
#: a line with its end
PARAGRAPH = r"[^\n]*\n|[^\n]+"
#: up to eight words, the last of a sentence at the end; whatever the text, pieces cover it without gaps
PIECE = rf"(?:{_W}{{0,39}}{_I}{_S}+){{0,7}}{_W}{{1,40}}{_S}*|{_S}+"
#: hexadecimal digits of a node below the root that a fingerprint keeps
DIGITS = 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _node(level: str, below: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(below, "")), 256)


def _short(node: Column) -> Column:
    return F.substring(node, 1, DIGITS)


def _paragraph(text: Column) -> Column:
    def made(pieces: Column) -> Column:
        return F.struct(
            _node("p", pieces).alias("node"), F.char_length(text).alias("chars"), F.transform(pieces, _short).alias("pieces"),
            F.regexp_like(text, F.lit(rf"\A{_S}*\z")).alias("blank"),
        )

    return _let(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda piece: F.sha2(piece, 256)), made)


def _section(paragraphs: Column) -> Column:
    return F.struct(_node("s", paragraphs["node"]).alias("node"), F.transform(paragraphs, lambda p: F.struct(_short(p["node"]).alias("node"), p["chars"].alias("chars"), p["pieces"].alias("pieces"))).alias("paragraphs"))


def _sections(paragraphs: Column) -> Column:
    def closes(i: Column) -> Column:
        p = F.element_at(paragraphs, i)
        return p["blank"] | (F.substring(p["node"], 1, 1) == "0") | (i == F.size(paragraphs))

    def cut(ends: Column) -> Column:
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        return F.transform(ends, lambda end, k: _section(F.slice(paragraphs, begin(k) + 1, end - begin(k))))

    numbers = F.when(F.size(paragraphs) > 0, F.sequence(F.lit(1), F.size(paragraphs))).otherwise(F.array().cast("array<int>"))
    return _let(F.filter(numbers, closes), cut)


def tree(text: Column) -> Column:
    """``struct<root, sections<node, paragraphs<node, chars, pieces>>>`` of a whole text, null as empty.

    An empty text has no section; its root is that of nothing.  Very long texts and words
    are cut into pieces like any others.
    """

    def made(sections: Column) -> Column:
        return F.struct(
            _node("r", sections["node"]).alias("root"),
            F.transform(sections, lambda s: F.struct(_short(s["node"]).alias("node"), s["paragraphs"].alias("paragraphs"))).alias("sections"),
        )

    paragraphs = F.transform(F.regexp_extract_all(whole(text), F.lit(PARAGRAPH), F.lit(0)), _paragraph)
    return _let(_let(paragraphs, _sections), made)


def fingerprint(of: Column) -> Column:
    """A tree as text: root, then ``;section`` with ``:paragraph=piece,piece`` for each branch."""
    lines = lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.concat(F.lit(":"), p["node"], F.lit("="), F.array_join(p["pieces"], ","))), "")
    return F.concat(of["root"], F.array_join(F.transform(of["sections"], lambda s: F.concat(F.lit(";"), s["node"], lines(s))), ""))


def pieces(of: Column) -> Column:
    """The different pieces of a tree."""
    return F.array_distinct(F.flatten(F.flatten(of["sections"]["paragraphs"])["pieces"]))


def _packed(nodes: Column) -> Column:
    """Nodes as they travel: eight bytes each."""
    return F.unhex(F.array_join(nodes, ""))


def _unpacked(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(root_a: Column, pieces_a: Column, root_b: Column, pieces_b: Column) -> Column:
    """Share of equal nodes of two trees (roots and different pieces), 1 for equal texts only.

    Twice the nodes that both have, divided by the nodes of each added up.
    """
    same = F.size(F.array_intersect(pieces_a, pieces_b)) + (root_a == root_b).cast("int")
    return 2.0 * same / (F.size(pieces_a) + F.size(pieces_b) + 2)


def paragraph_nodes(of: Column) -> Column:
    return F.flatten(of["sections"]["paragraphs"])["node"]


def changes(a: Column, b: Column) -> Column:
    """Paragraphs of tree ``a`` in branches that ``b`` has nowhere: ``array<struct<section, paragraph, chars>>``.

    Counted from zero.  Only branches whose sections differ are compared, paragraph by
    paragraph; equal roots give an empty array.
    """
    none = F.array().cast("array<struct<section:int,paragraph:int,chars:int>>")
    others = F.array_except(b["sections"]["node"], a["sections"]["node"])
    open_b = F.filter(b["sections"], lambda s: F.array_contains(others, s["node"]))

    def differing(there: Column) -> Column:
        def of_section(s: Column, i: Column) -> Column:
            own = F.transform(s["paragraphs"], lambda p, k: F.struct(i.alias("section"), k.alias("paragraph"), p["chars"].alias("chars"), p["node"].alias("node")))
            new = F.filter(own, lambda p: ~F.array_contains(there["paragraphs"], p["node"]))
            place = lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), p["chars"].alias("chars"))
            return F.when(F.array_contains(there["sections"], s["node"]), none).otherwise(F.transform(new, place))

        return F.flatten(F.transform(a["sections"], of_section))

    there = F.struct(b["sections"]["node"].alias("sections"), F.flatten(open_b["paragraphs"])["node"].alias("paragraphs"))
    return F.when(a["root"] == b["root"], none).otherwise(_let(there, differing))


def _key(row_id: Column, text: Column) -> Column:
    """One digest for an id and its text; rows repeated with both are one document."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("+"), row_id.cast("string")), F.lit("-")), F.lit(":"), text), 256))


def _order(docs: DataFrame) -> DataFrame:
    """Every different document with the one behind it: ``key, id, copies, half, next_key``.

    Ids descend, null ids come last, documents with one id follow their digests, and after
    the last comes the first.  Only keys and ids are sorted; a window sees one range
    partition, and one row of each partition joins the ranges.
    """
    narrow = docs.select(_key(F.col("id"), F.col("text")).alias("key"), "id", F.char_length("text").alias("n"))
    keys = narrow.groupBy("key").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = [F.desc_nulls_last("id"), F.asc("key")]
    ranges = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = ranges.withColumn("following", F.lead("key").over(inside)).withColumn("at", F.row_number().over(inside))
    heads = rows.filter("at = 1").select("part", F.col("key").alias("head"))
    around = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(around), F.first("head").over(around.rowsBetween(Window.unboundedPreceding, 0))).alias("next_head"))
    return rows.join(heads, "part").select("key", "id", "copies", "n", F.floor(F.col("n") / 2).cast("int").alias("half"), F.coalesce("following", "next_head").alias("next_key"))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its edited form: ``id_col, n_chars, next_id, edited, tree, edited_tree, next_root, next_pieces``.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as
    many (or all) of the next document, in descending order of ids (null ids last, several
    texts of one id by digest, after the last the first).  A lone document is its own next.

    Null texts count as empty.  Rows that repeat an id with its text are aggregated before
    the shuffle, have one next document and give as many equal rows.  An empty table gives
    no rows.  Columns other than the two are not read, whatever their names.  A text
    travels once to its key; the next document sends half of its reader's length and its pieces.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    texts = rows.select(_key(F.col("id"), F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    order = stored(_order(rows), "followers")
    readers = order.select(F.col("next_key").alias("key"), F.col("key").alias("reader"), "half", F.col("id").alias("reader_id"))
    sent = texts.join(readers, "key").select("reader", F.substring("text", F.lit(1), F.col("half")).alias("begin"), tree(F.col("text")).alias("next"))
    sent = sent.select(F.col("reader").alias("key"), "begin", F.col("next.root").alias("next_root"), _packed(pieces(F.col("next"))).alias("next_pieces"))
    next_ids = order.select(F.col("key").alias("next_key"), F.col("id").alias("next_id"))
    own = order.join(next_ids, "next_key").select("key", "id", "copies", "n", "half", "next_id")
    met = texts.join(own, "key").join(sent, "key")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("half")), F.col("begin"))
    made = met.select("id", "copies", F.col("n").cast("long").alias("n_chars"), "next_id", edited.alias("edited"), tree(F.col("text")).alias("tree"), "next_root", _unpacked(F.col("next_pieces")).alias("next_pieces"))
    made = made.select("*", tree(F.col("edited")).alias("edited_tree"))
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "n_chars", "next_id", "edited", "tree", "edited_tree", "next_root", "next_pieces"
    )
