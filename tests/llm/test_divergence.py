import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from helpers import duck, normal

from quizmill.llm import divergence
from quizmill.llm.divergence import OP13_SQL, op13_source_divergence, share, source_divergence, terms

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        found = WORD.findall((text or "").translate(LOW))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: chance(counts[lang, s]) for s in sources}
        q = chance(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", over)) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_terms_are_those_of_the_pattern():
    texts = ["", "Ünder The-sea tHe é1é", "a", "b", "@[`{", "x" * 70000 + " x\x00y", "日本 aß", "END"]
    found = pa.array(["not seen", *texts, "nor this"]).slice(1, len(texts))
    for hashed in (None, lambda b: len(b) % 2, lambda b: 7):
        of, kind, kinds = terms(found, hashed) if hashed else terms(found)
        got = [[] for _ in texts]
        for t, k in zip(of, kind, strict=True):
            got[t].append(kinds[k].decode())
        assert got == [WORD.findall(t.translate(LOW)) for t in texts]
        assert len(set(kinds)) == len(kinds)
    assert terms(pa.array([], pa.string()))[2] == [] and terms(pa.array(["12", ""]))[2] == []


def test_share_is_exact_beyond_64_bits():
    for n, total in ((0, 1), (7, 7), (10**14 + 3, 3 * 10**14 + 1), (8 * 10**15, 8 * 10**15 + 5)):
        assert share(n, total) == 10**9 * n // total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert normal(op13_source_divergence(spark, folder).toPandas()).equals(normal(duck(folder).execute(OP13_SQL).df()))


def test_many_blocks_and_tiles_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = [(" ".join(f"w{chr(97 + (k * j) % 23)}" for j in range(k % 9 + 1)) + " Café", ["en", None, "de"][k % 3], f"s{k % 7}" if k % 11 else None) for k in range(90)]
    rows += [(None, "en", "only nulls"), ("", "xx", "a"), ("rare", "xx", "b"), ("lone", "yy", None)] + [("same same words", "en", "s1")] * 5
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, `rank` int").repartition(5)
    for top in (2, 50):
        got = sorted(map(tuple, source_divergence(docs, least_documents=3, top=top).collect()))
        assert got == plain(rows, 3, top)
    assert ("xx", "a", "pair", "b", 0, 1) in got
    assert source_divergence(docs.limit(0)).collect() == []


def test_one_hot_source(spark):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k % 5)} common", "en", "hot" if k % 3 else f"s{k % 4}") for k in range(400)] + [("z" * 60000 + " common", "en", "hot")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert sorted(map(tuple, source_divergence(docs, least_documents=10).collect())) == plain(rows, 10, 50)
