import hashlib
import re

from pyspark.sql import functions as F

from factloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_pieces(line):
    """Words with the white space behind them, up to eight, a sentence end closes; words are cut after 40."""
    parts = re.findall(r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", line)
    out, held = [], []

    def close():
        if held:
            out.append("".join(held))
            held.clear()

    for part in parts:
        word = re.match(r"[^ \t-\r]*", part)[0]
        if not word:
            out.append(part)
            continue
        space = part[len(word) :]
        chunks = [word[i : i + 40] for i in range(0, len(word), 40)]
        for k, chunk in enumerate(chunks):
            last = k == len(chunks) - 1
            held.append(chunk + (space if last else ""))
            if not last or not space or chunk[-1] in ".!?" or len(held) == 8:
                close()
    close()
    return out


def plain_tree(text):
    sections, held = [], []
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    for i, line in enumerate(lines):
        pieces = [sha(p) for p in plain_pieces(line)]
        assert "".join(plain_pieces(line)) == line
        held.append((sha("p" + "".join(pieces)), len(line), pieces))
        if not line.strip(" \t\n\x0b\x0c\r") or held[-1][0][0] == "0" or i == len(lines) - 1:
            sections.append((sha("s" + "".join(p[0] for p in held)), held))
            held = []
    return sha("r" + "".join(s[0] for s in sections)), sections


def plain_fingerprint(text):
    root, sections = plain_tree(text)
    branch = lambda p: ":" + p[0][:16] + "=" + ",".join(x[:16] for x in p[2])
    return root + "".join(";" + s[0][:16] + "".join(map(branch, s[1])) for s in sections)


def plain_likeness(a, b):
    (ra, sa), (rb, sb) = plain_tree(a), plain_tree(b)
    pa, pb = ({x for s in t for p in s[1] for x in p[2]} for t in (sa, sb))
    return 2 * (len(pa & pb) + (ra == rb)) / (len(pa) + len(pb) + 2)


def found(docs):
    got = merkle.against_next(docs)
    own, edited = F.col("tree"), F.col("edited_tree")
    return got.select(
        "doc_id", "n_chars", "next_id", "edited", merkle.fingerprint(own).alias("f"), merkle.fingerprint(edited).alias("e"),
        merkle.likeness(own["root"], merkle.pieces(own), F.col("next_root"), F.col("next_pieces")).alias("near"),
    ).collect()


def test_fingerprints_of_messy_rows(spark, messy, none):
    rows = sorted({(r.doc_id, r.text or "") for r in messy.collect()}, key=lambda r: (r[0] is None, -(r[0] or 0), sha(f"+{r[0]}:{r[1]}" if r[0] is not None else f"-:{r[1]}")))
    want = {}
    for (i, text), (j, behind) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        want[i, text] = (len(text), j, text[: len(text) - half] + behind[:half], behind)
    got = found(messy)
    assert len(got) == messy.count()
    by = {(i, plain_fingerprint(t)): w for (i, t), w in want.items()}
    for r in got:
        n, j, edited, behind = by[r.doc_id, r.f]
        assert (r.n_chars, r.next_id, r.edited, r.e) == (n, j, edited, plain_fingerprint(edited))
        text = next(t for (i, t) in want if i == r.doc_id and plain_fingerprint(t) == r.f)
        assert abs(r.near - plain_likeness(text, behind)) < 1e-12
    assert found(none) == []


def test_lone_document(spark):
    (row,) = found(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"))
    assert row.next_id == 1 and row.edited == "one two tone two t" and row.near == 1.0


def test_many_ranges(spark):
    """Every document meets the one with the next smaller id, over the borders of ranges."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(700).selectExpr("id * 3 as doc_id", "concat('text of ', id) as text").repartition(16)
        got = {r.doc_id: r.next_id for r in found(docs)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {3 * k: 3 * (k - 1) if k else 3 * 699 for k in range(700)}


def test_repeated_rows_and_long_words(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 50 + [(0, "w" * 100_000), (2, "a\n\nb. c d\n" * 300)], "doc_id long, text string")
    got = found(docs)
    assert len(got) == 52 and len({(r.doc_id, r.f) for r in got}) == 3
    assert {r.f for r in got if r.doc_id == 2} == {plain_fingerprint("a\n\nb. c d\n" * 300)}


def test_differing_branches_locate_an_edit(spark):
    lines = [f"line {k} holds a few words of its own. And more.\n" for k in range(400)]
    other = lines[:200] + ["an inserted line\n"] + lines[200:300] + ["a changed line\n"] + lines[301:]
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    df = df.select("*", merkle.changes(F.col("b"), F.col("a")).alias("new"), merkle.changes(F.col("a"), F.col("b")).alias("gone"), merkle.changes(F.col("a"), F.col("a")).alias("same"))
    row = df.first()
    before = [sum(len(s.paragraphs) for s in row.b.sections[: c.section]) + c.paragraph for c in row.new]
    assert before == [200, 301] and [c.chars for c in row.new] == [17, 15]
    assert [sum(len(s.paragraphs) for s in row.a.sections[: c.section]) + c.paragraph for c in row.gone] == [300]
    assert row.same == [] and len(row.a.sections) > 10
    assert len({s.node for s in row.a.sections} & {s.node for s in row.b.sections}) >= len(row.a.sections) - 2


def test_only_built_in_functions(spark, sf_dir):
    from factloom.llm import queries

    plan = queries.op13_merkle(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
