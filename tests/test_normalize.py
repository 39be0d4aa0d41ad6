import pytest
from pyspark.sql import functions as F

from factloom.operators import normalize as nm

CASES = [
    ("NASA    confirms     Earth", "nasa confirms earth"),
    ("NASA\nconfirms\tEarth", "nasa confirms earth"),
    ("   NASA confirms Earth   ", "nasa confirms earth"),
    ("NASA confirms Earth", "nasa confirms earth"),
    ("NASA CONFIRMS EARTH", "nasa confirms earth"),
    ("ＮＡＳＡ", "nasa"),
    ("café", "café"),
    ("NASA confirms Earth!!!", "nasa confirms earth"),
    ("Is Earth flat???", "is earth flat"),
    ("Earth is round....", "earth is round"),
    ("Earth isn't flat", "earth isn't flat"),
    ("NASA's discovery", "nasa's discovery"),
    ("N A S A confirms Earth", "nasa confirms earth"),
    ("E S A confirms", "esa confirms"),
    ("A B C D E F stays", "a b c d e f stays"),
    ("NASA 🚀 confirms Earth 🌍", "nasa confirms earth"),
    ("NASA confirms Earth #NASA #Breaking", "nasa confirms earth"),
    ("@NASA confirms Earth @news", "confirms earth"),
    ("See https://example.com for proof", "see for proof"),
    ("Check www.nasa.gov", "check"),
    ("சென்னை மழை", "சென்னை மழை"),
    ("ഭൂമി ഉരുണ്ടത്", "ഭൂമി ഉരുണ്ടത്"),
    ("पृथ्वी गोल है", "पृथ्वी गोल है"),
    ("الأرض كروية", "الأرض كروية"),
    ("", ""),
    ("   ", ""),
    ("a\x00b\x07c", "a b c"),
]


@pytest.fixture(scope="module")
def normalized(spark):
    rows = [(i, raw) for i, (raw, _) in enumerate(CASES)]
    df = nm.normalize_claims(spark.createDataFrame(rows, "id int, claim string"))
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_canonical_text(normalized, i):
    assert normalized[i].normalized == CASES[i][1]


def _one(spark, text):
    return nm.claim_identity(spark.createDataFrame([(text,)], "claim string")).first()


def test_metadata(spark):
    m = _one(spark, "NASA found 95% in 5 km for $100 on 12/08/2026 #x @y not 3.14").metadata
    assert m.hashtags == ["x"] and m.mentions == ["y"] and m.entities == ["NASA"]
    assert m.percentages == ["95%"] and m.units == ["5 km"] and m.currency == ["$100"]
    assert m.dates == ["12/08/2026"] and m.negation == ["not"] and "3.14" in m.numbers


def test_warnings(spark):
    assert _one(spark, "on 12/08/2026 🚀").warnings == [
        "Decorative emoji removed from canonical claim",
        "Ambiguous date format detected (locale-dependent)",
    ]
    long = _one(spark, "a" * 10001)
    assert len(long.normalized) == 10000 and "truncated" in long.warnings[0]


def test_identity_groups(spark):
    base = "NASA confirms Earth will experience three days of darkness"
    same = [base, base.upper(), f"  {base}!!! "]
    other = [base.replace("three", "five"), base.replace("NASA", "ESA"), base.replace("confirms", "denies")]
    rows = spark.createDataFrame([(t,) for t in same + other], "claim string")
    hashes = [r.claim_hash for r in nm.claim_identity(rows).collect()]
    assert len(set(hashes[:3])) == 1 and len(set(hashes)) == 4


def test_idempotent(spark):
    rows = spark.createDataFrame([(raw,) for raw, _ in CASES], "claim string")
    assert nm.idempotency_rate(rows).first().rate == 1.0


def test_cache_key_round_trip(spark):
    h = "a" * 64
    keys = [f"factloom:claim:v1:{h}", f"x:claim:v1:{h}", f"factloom:other:v1:{h}", "factloom:claim:v1", f"factloom:claim:v1:{'g' * 64}", f"factloom:claim:v1:{h[:-1]}"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(nm.parse_cache_key(F.col("k")).alias("p"))
    parsed = [r.p for r in df.collect()]
    assert parsed[0].hash == h and parsed[0].version == "v1" and parsed[1:] == [None] * 5
