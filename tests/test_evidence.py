import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factloom.functions.udfs import main_text, word_edit_distance
from factloom.operators import evidence as ev
from factloom.operators import ranking as rk
from factloom.operators import sources as so


def test_main_text_prefers_article_and_drops_boilerplate():
    body = "Useful words here. " * 20
    html = f"<html><body><nav>menu</nav><div class='ad-box'>buy</div><article><p>{body}</p><script>x</script></article><footer>f</footer></body></html>"
    text = main_text(html, 200, 50000)
    assert text.startswith("Useful words") and "menu" not in text and "buy" not in text and "x<" not in text
    assert main_text("short", 200, 50000) is None
    assert main_text("plain " * 100, 200, 300).endswith("...")


def plain_chunks(text, least, most, overlap):
    """The same sequentially, a sentence at a time."""
    out, held = [], []
    size = lambda: sum(len(s.split()) for s in held)

    def close():
        out.append(" ".join(held))

    for sentence in re.split(r"(?<=[.!?])\s+", text):
        parts = re.split(r"(?<=,)\s+", sentence) if len(sentence.split()) > most else None
        for part in parts or [sentence]:
            if size() + len(part.split()) <= most:
                held.append(part)
            elif parts:
                if held:
                    close()
                held = [part]
            else:
                if size() >= least:
                    close()
                held = held[max(0, len(held) - overlap) :] + [part]
    if held and size() >= least:
        close()
    return out


def test_chunks_against_a_plain_loop(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["w", "word", "a,", "b.", "c!", "x"])
    sentence = lambda n: " ".join(f"w{rng.randint(0, 9)}" for _ in range(n)) + "."
    texts = ["", "one", " \n ", "too short.", "word, " * 700, "word " * 700, " ".join(sentence(rng.randint(1, 40)) for _ in range(200))]
    texts += ["".join(word() + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [sentence(90) + " " + "long, " * 150 + sentence(3) + " " + sentence(60)]
    for least, most, overlap in ((50, 100, 1), (5, 20, 1), (5, 20, 2), (1, 8, 0), (50, 500, 1)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        for r in df.select("i", ev.chunks(F.col("text"), least, most, overlap).alias("c")).collect():
            assert r.c == plain_chunks(texts[r.i], least, most, overlap), (r.i, least, most, overlap)


def test_word_edit_distance():
    def slow(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1, -1]

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    others = texts[3:] + texts[:3]
    got = word_edit_distance.func(pd.Series(texts), pd.Series(others))
    assert list(got) == [slow(a.split(), b.split()) for a, b in zip(texts, others)]


def test_urls(spark):
    rows = [
        ("HTTPS://u@Example.com:443/a?utm_source=x&id=1#f", "https://example.com/a?id=1", True),
        ("http://example.com/?ref=1", "http://example.com/", True),
        ("ftp://example.com/", None, False),
        ("http://10.1.2.3/", "http://10.1.2.3/", False),
        ("http://172.32.0.1/", "http://172.32.0.1/", True),
        ("http://169.254.169.254/x", "http://169.254.169.254/x", False),
        ("http://localhost:80/", "http://localhost/", False),
        ("garbage", None, False),
    ]
    df = spark.createDataFrame(rows, "url string, want string, safe boolean")
    for r in df.select("*", so.normalize_url(F.col("url")).alias("got"), so.is_safe_url(F.col("url")).alias("ok")).collect():
        assert r.got == r.want and r.ok == r.safe


def test_greedy_near_copies_keep_first(spark):
    base = [f"w{i}" for i in range(20)]
    texts = [base, base[:19] + ["x"], base[:17] + ["x", "y", "z"], ["other"] * 3, base]
    df = spark.createDataFrame(
        [(1, i, " ".join(t), "h", str(i)) for i, t in enumerate(texts)],
        "claim_id long, pos int, excerpt string, host string, content_hash string",
    )
    kept = {r.pos for r in rk.drop_near_copies(df).collect()}
    assert kept == {0, 2, 3}


def test_package_for_every_claim(spark):
    claims = spark.createDataFrame([(1,), (2,)], "claim_id long")
    ranked = spark.createDataFrame(
        [(1, 1, "SUPPORTS", "x", "u", "t", "p", None, 0.5, 0.5, 0.5, "UNKNOWN", "h", 0, "s", 0.5)],
        "claim_id long, evidence_rank int, direction string, excerpt string, url string, title string, publisher string, published_at timestamp, "
        "relevance double, authority double, recency double, source_type string, host string, chunk_index int, content_hash string, combined double",
    )
    got = {r.claim_id: r.status for r in rk.package_evidence(claims, ranked).collect()}
    assert got == {1: "SUCCESS", 2: "NO_USABLE_EVIDENCE"}


def test_scores_are_bounded(spark):
    claims = spark.createDataFrame([(1, "The cat sat on 12 mats in Paris"), (2, "of the")], "claim_id long, claim string")
    chunks = spark.createDataFrame([(9, 0, "A cat sat on 12 mats near Paris, a study found."), (9, 1, "nothing here")], "page_id long, chunk_index int, chunk string")
    pairs = spark.createDataFrame([(1, 9), (2, 9)], "claim_id long, page_id long")
    rows = ev.extract_evidence(claims, chunks, pairs, min_relevance=0.0).collect()
    assert all(0.0 <= r.relevance <= 1.0 for r in rows) and len(rows) == 4
    assert {r.direction for r in rows if r.chunk_index == 0} == {"SUPPORTS"}
