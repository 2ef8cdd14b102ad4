import hashlib
import random
import re
from collections import Counter

from quizmill.llm.decontam import build_index, contamination, proximity_matches, uncontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute_near(docs, items, within=None):
    """For each of docs the items all of whose words are within twice its words (or so many) of a place of its rarest."""
    held = [WORD.findall((t or "").translate(LOW)) for _, t in docs]
    df = Counter(w for h in held for w in h)
    out = []
    for h in held:
        ids = set()
        for item, text in items:
            w = WORD.findall((text or "").translate(LOW))
            if w:
                reach = 2 * len(w) if within is None else within
                rare = min(set(w), key=lambda x: (df[x], x.encode()))
                if any(set(w) <= set(h[max(0, k - reach) : k + reach + 1]) for k, x in enumerate(h) if x == rare):
                    ids.add(item)
        out.append(ids)
    return out


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        n = min(size, len(w))
        for s in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    ids |= {str(x) for x in found} - {"None"}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    near = [sorted({str(x) for x in ids} - {"None"}) for ids in brute_near(docs, items)]
    return sorted([(*o, len(n), hashlib.sha256(",".join(n).encode()).hexdigest()) for o, n in zip(out, near, strict=True)], key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force_on_the_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(contamination(docs, items)) == expected and any(r[2] for r in expected) and any(r[6] for r in expected) and max(len(t) for _, t in rows) > 6000


def test_nulls_ties_empty_and_extra_columns(spark):
    ten = "a b c d e f g h i j"
    docs = [(1, None), (2, ""), (3, "... !!"), (4, f"X {ten} k l y"), (4, f"X {ten} k l y"), (None, "short ONE"), (5, "short"), (6, f"{ten} " * 500), (7, "a b c d e f g h i k"), (8, "q q q q q q q q q q q q"), (9, "Été,été short-one")]
    items = [(1, f"{ten} k l m"), (2, "Short one"), (2, "short one"), (None, "q " * 11), (3, None), (4, "!"), (10, "never seen words"), (11, "c d e f g h i j k l")]
    d = spark.createDataFrame([(*r, 0, "z") for r in docs], "doc_id long, text string, row int, term string")
    b = spark.createDataFrame([(*r, 0, "z") for r in items], "item_id long, text string, item int, pos string")
    assert got(contamination(d, b)) == brute(docs, items)
    assert got(contamination(d.limit(0), b)) == []
    assert got(contamination(d, b.limit(0))) == brute(docs, [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha x x x x x x beta gamma"), (4, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = build_index(docs, items)
    near = proximity_matches(index, 4).join(index.documents, "row").select("doc_id").distinct()
    assert sorted(r[0] for r in near.collect()) == [1, 2]


def test_proximity_in_long_texts(spark):
    """Words around the ends of blocks, items of words that are everywhere, repeated rows, and an item with a word that no text has."""
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(n)) for n in (0, 5, 63, 64, 65, 500, 3000)] + ["x " * 130 + "rare y z", "rare " + "x " * 70 + "y z"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, texts[4])]
    items = [(1, "a b c d"), (2, "rare y z x"), (3, "a nowhere"), (4, "h"), (5, "a a a b"), (6, "rare " + "x " * 33 + "y"), (7, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = build_index(d, b)
    for within in (None, 2, 70, 64):
        found = proximity_matches(index, within).join(index.phrases.where("off = 0").select("item", "item_id"), "item").join(index.documents, "row")
        near = sorted({(r["row"], str(r["doc_id"]), r["item_id"]) for r in found.collect()})
        assert Counter((i, x) for _, i, x in near) == Counter((str(i), str(x)) for (i, _), ids in zip(docs, brute_near(docs, items, within), strict=True) for x in ids)
    assert got(contamination(d, b)) == brute(docs, items)


def test_uncontaminated_keeps_rows_and_columns(spark):
    ten = "a b c d e f g h i j"
    rows = [(1, None, 0, "x"), (2, f"{ten} k", 0, "x"), (2, "fine", 0, "x"), (None, ten, 0, "x"), (None, "", 1, None), (None, "", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `mark_` int, `kept.it` string")
    items = spark.createDataFrame([(1, ten), (2, None)], "item_id long, text string")
    out = uncontaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    assert uncontaminated(docs, items.limit(0)).count() == 6
