import itertools
from collections import defaultdict

import pytest

from airledger.llm import queries
from airledger.llm.lookalikes import canonical_texts, lookalike_pairs, published_letters

SAME = [
    ("camera", "саmеrа"), ("The end", "Τhе end"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("soft", "so­ft"), ("zero", "ze​ro"),
    ("wide 12", "ｗｉｄｅ １２"), ("résumé", "résumé"), ("filter", "ﬁlter"), ("office", "oﬃce"), ("10 °C", "10 ℃"),
    ("00-001", "00‐001"), ("00-001", "00‑001"), ("5 µg", "5 μg"), ("one\ntwo", "one\r\ntwo"), ("ёлка", "ёлка"), ("κόσμο", "κóσμo"), ("가다", "가다"), ("fog \U0001f32b", "fog \U0001f32b️"),
]
SAME += [
    ("gap", "ɡap"), ("van", "νan"), ("lip", "ӏip"), ("on", "օn"), ("Axe", "Ꭺxe"), ("I am", "Ⅰ am"), ("Axe", "𝐀xe"), ("7 m", "𝟕 m"), ("Axe", "ꓮxe"), ("nap", "ոap"), ("very", "ѵerу"), ("ρh", "ph"),
    ("Quick", "Ԛuick"), ("year", "үear"),
]
DIFFERENT = [
    ("resume", "résumé"), ("Fur", "Für"), ("second", "SECOND"), ("m3", "m³"), ("1", "l"), ("0", "O"), ("a b", "a  b"), ("a b", "ab"), ("a-b", "a–b"), ("12", "21"),
    ("ab.", "ab"), ("a\nb", "a b"), ("½", "1/2"), ("lot", "lo̸t"), ("x", "х́"), ("ñ", "n"), ("'", "’"), ("и", "й"),
    ("i", "ı"), ("a", "α"), ("2", "²"), ("1", "①"), ("a", "ª"), ("!", "ǃ"), ("-", "−"), ("-", "—"), ('"', "“"), ("w", "ω"), ("f", "ſ"), ("o", "σ"), ("i", "ι"), ("u", "υ"), ("r", "г"), ("rn", "m"), ("vv", "w"),
]


def test_pairs(spark):
    rows, want = [], set()
    for k, (a, b) in enumerate(SAME):
        rows += [(2 * k, f"{a} same {k}", "x"), (2 * k + 1, f"{b} same {k}", "x")]
        want.add((2 * k, 2 * k + 1))
    n = len(rows)
    for k, (a, b) in enumerate(DIFFERENT):
        rows += [(n + 2 * k, f"{a} diff {k}", "x"), (n + 2 * k + 1, f"{b} diff {k}", "x")]
    rows += [(900, None, "x"), (901, None, "x"), (902, "", "x"), (903, "", "x"), (904, "twice", "x"), (905, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    got = {tuple(r) for r in lookalike_pairs(df).collect()}
    texts = {i: t for i, t, _ in rows}
    assert got == want, [(texts[a], texts[b]) for a, b in got ^ want]
    forms = {r["doc_id"]: (r["class_id"], r["canonical"]) for r in canonical_texts(df).collect()}
    assert set(forms) == set(texts)
    for a, b in want:
        assert forms[a] == forms[b] and forms[a][0] == min(a, b)
    for k in range(len(DIFFERENT)):
        assert forms[n + 2 * k][0] != forms[n + 2 * k + 1][0]
    assert forms[900] == (900, None) and forms[903] == (903, "") and forms[905] == (904, "twice")


def test_many_copies_and_long_texts(spark):
    long = "x" * 200_000
    rows = [(i, "the camera") for i in range(300)] + [(1000, "the саmera"), (1001, "the саmera"), (2000, long), (2001, long + "​")]
    got = {tuple(r) for r in lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, j) for i in range(300) for j in (1000, 1001)} | {(2000, 2001)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lookalike_pairs(df).collect() == [] == canonical_texts(df).collect()


@pytest.mark.parametrize("scale", ["tiny", "small"])
def test_pairs_agree_with_forms(spark, request, scale):
    """Pairs are exactly the differing texts of one class."""
    d = request.getfixturevalue(scale)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    classes = defaultdict(list)
    for r in queries.p9_canonical(spark, d).collect():
        if texts[r["doc_id"]]:
            classes[r["class_id"]].append(r["doc_id"])
    want = {(min(a, b), max(a, b)) for ids in classes.values() for a, b in itertools.combinations(ids, 2) if texts[a] != texts[b]}
    assert {tuple(r) for r in queries.p9_found(spark, d).collect()} == want


def test_letters_come_from_published_data(spark):
    version, letters = published_letters()
    assert int(version.split(".")[0]) >= 15
    assert {"А": "A", "е": "e", "Ꮲ": "P", "ν": "v", "Ⅽ": "C"}.items() <= letters.items()
    assert all(len(a) == 1 and len(b) == 1 and b.isascii() and b.isalpha() for a, b in letters.items())
    assert all(a.isupper() == b.isupper() for a, b in letters.items() if a.isupper() or a.islower())
