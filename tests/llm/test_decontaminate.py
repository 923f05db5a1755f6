from collections import Counter

import numpy as np

from tidemark.llm.decontaminate import Index, _matches, leaks, question_answer, trigrams, without_leaks, words_of

SF = "/root/testdata/sf0.01"


def brute(docs, items, threshold=0.5, overlap=0.5):
    """Scores every passage against every item term by term."""
    items = [(i, words_of(t), t) for i, t in items if words_of(t)]
    df = Counter(w for _, ws, _ in items for w in set(ws))
    mean, half = sum(len(w) for _, w, _ in items) / len(items), max(len(w) for _, w, _ in items)

    def score(item, have):
        return sum(np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(item) / mean)) for w, n in Counter(item).items() if w in have)

    own = [score(w, set(w)) for _, w, _ in items]
    out = set()
    for d, t in docs:
        words = words_of(t)
        for at in range(0, len(words), half):
            here = words[at : at + 2 * half]
            for (i, item, text), most in zip(items, own):
                if score(item, set(here)) / most >= threshold - 1e-9:
                    share = []
                    for part in question_answer(text):
                        g = trigrams(part)
                        n = len(next(iter(g), ()))
                        share.append(len(g & {tuple(here[k : k + n]) for k in range(len(here) - n + 1)}) / len(g) if g else 1)
                    if min(share) >= overlap:
                        out.add((d, i))
    return out


def test_matches_scores_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(250).collect()]
    planted = [(10_000 + r.item_id, f"some words before {r.text.upper()} and after it") for r in items.collect()]
    fixture = spark.createDataFrame(rows + planted, "doc_id long, text string")
    want = brute(rows + planted, [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id) for r in leaks(fixture, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks(fixture, items, shard=7).collect()} == want
    assert all((10_000 + r.item_id, r.item_id) in want for r in items.collect())
    assert without_leaks(fixture, items).count() == len(rows + planted) - len({d for d, _ in want})


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "What is the colour of the sky? It is blue today."), (1, "What is the colour of the sky? It is blue today."), (2, None), (3, ""), (None, "x y z"), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "so: what is the colour of the sky? it is blue today!", 0), (4, "word " * 50000 + "What is the colour of the sky? It is blue today.", 0), (5, "It is blue today.", 0)], "doc_id long, text string, item_id int")
    assert sorted((r.doc_id or 0, r.item_id) for r in leaks(docs, items).collect()) == [(0, 1), (4, 1)]
    assert without_leaks(docs, items).count() == 4
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_search_gives_all_items_at_the_threshold(monkeypatch):
    """Pivots and block bounds lose no item: the scores of all pairs, at several thresholds and in small runs."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 25) % 300)) for i in range(150)]
    df = Counter(w for _, t in texts for w in set(t.split()))
    index = Index(texts, df, 150, 25.0)
    passages = [sorted({index.terms[w] for w in f"{texts[k][1]} {texts[-k][1]}".split()}) for k in range(40)]
    p, t = np.repeat(np.arange(40), [len(x) for x in passages]), np.concatenate(passages)
    term = np.repeat(index.keys // index.blocks, np.diff(index.first))
    for threshold in (0.2, 0.5, 0.9):
        want = {}
        for k, terms in enumerate(passages):
            score = np.bincount(index.item[np.isin(term, terms)], index.impact[np.isin(term, terms)], 150)
            want |= {(k, int(i)): round(float(score[i]), 9) for i in np.flatnonzero(score >= threshold - 1e-9)}
        for rows in (1, 64, 1 << 20):
            monkeypatch.setattr("tidemark.llm.decontaminate.ROWS", rows)
            got = index.search(p, t, threshold)
            assert {(int(a), int(b)): round(float(c), 9) for a, b, c in zip(*got)} == want
    assert len(want) >= 40


def test_a_text_of_half_a_million_words_and_many_items():
    """Peak memory beyond the words themselves stays small for a very long text against 5,000 items."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 40_000)) for i in range(5_000)]
    df = Counter(w for _, t in texts for w in set(t.split()))
    index = Index(texts, df, 5_000, 60.0)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 500_000) % 40_000]
    words[300_000:300_060] = texts[77][1].split()
    tracemalloc.start()
    found = set((d, i) for d, i, *_ in _matches(index, [(1, words)], 0.5, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (1, 77) in found and peak < 400e6
