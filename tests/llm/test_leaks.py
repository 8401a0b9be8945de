import random

import numpy as np
import pandas as pd

from ledgerloom.llm import leaks

DOCS = "doc_id long, text string, words int, h1 long"
ITEMS = "item_id long, suite string, passage string"


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        r = rng.integers(0, 5, n).astype(np.int32)
        got = leaks.suffix_array(r)
        want = sorted(range(n), key=lambda i: [*r[i : i + 32]])
        assert [list(r[i : i + 32]) for i in got] == [list(r[i : i + 32]) for i in want]


def test_words():
    assert leaks.word_list("The <b>$ 29,836</b>&nbsp;re-\nsale, firm's 2.6%") == ["the", "29836", "resale", "firms", "26"]
    assert leaks.word_list(None) == [] and leaks.word_list(" \n") == []


def sentence(rng, n):
    return " ".join("w" + str(rng.randint(0, 4000)) for _ in range(n))


def test_planted_leaks(spark):
    rng = random.Random(3)
    standard = " ".join(f"standard{i}" for i in range(30))
    items = [(i, "test", sentence(rng, 80) + ". " + standard) for i in range(8)]
    items += [(100, "dev", None), (101, "dev", ""), (102, "dev", "too short to leak"), (103, "dev", items[0][2])]
    docs, want = [], set()
    for i in range(60):
        t = sentence(rng, 150)
        if i % 2:
            t += " " + standard
        docs.append([i, t])

    def plant(doc, item, text, found):
        docs[doc][1] = docs[doc][1][:200] + "\n" + text + " " + docs[doc][1][200:]
        if found:
            want.add((doc, item))
            if item == 0:
                want.add((doc, 103))

    w = lambda i: items[i][2].split()
    plant(0, 0, " ".join(w(0)[:40]).upper(), True)
    plant(1, 1, ",  ".join(w(1)[10:38]), True)
    plant(2, 2, " ".join(w(2)[5:20] + sentence(rng, 40).split() + w(2)[20:40]), True)  # cut once
    changed = w(3)[:50]
    changed[12], changed[30] = "other", "word"
    plant(3, 3, "<p>" + " ".join(changed) + "</p>", True)
    plant(4, 4, " ".join(w(4)[:15]), False)  # a short quotation
    plant(6, 5, " ".join(w(5)[30:55]), True)  # exactly the length
    docs += [[200 + i, docs[0][1]] for i in range(40)]  # copies of one document: nearly half of all
    want |= {(200 + i, k) for i in range(40) for k in (0, 103)}
    docs += [[900, None], [901, ""], [902, "long " * 300_000]]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], DOCS).repartition(4)
    got = leaks.leaked_passages(df, spark.createDataFrame(items, ITEMS), shard_words=4000, block_words=400)
    found = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    whole = leaks.leaked_passages(df, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in whole} == want
    kept = {r.doc_id for r in leaks.clean_documents(df, got).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def found(spark, docs, items, **more):
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], DOCS).repartition(4)
    return {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, spark.createDataFrame(items, ITEMS), **more).collect()}


def test_repeated_and_overlapping_passages_are_no_standard_wording(spark):
    rng = random.Random(5)
    page = sentence(rng, 200).split()
    items = [(i, "test", " ".join(page)) for i in range(6)]
    items += [(10 + i, "test", " ".join(page[20 * i : 20 * i + 120])) for i in range(5)]
    docs = [(i, sentence(rng, 150)) for i in range(100)] + [(500, sentence(rng, 60) + " " + " ".join(page[80:120]) + " " + sentence(rng, 60))]
    want = {(500, i) for i, _, _ in items}
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_words=300) == want


def test_near_copies_do_not_make_a_passage_standard(spark):
    """A held-out passage in a text that a third of the rows repeat, each with one figure or space changed."""
    rng = random.Random(6)
    items = [(1, "test", sentence(rng, 80))]
    text = (sentence(rng, 40) + " 5000 " + " ".join(items[0][2].split()[:50]) + " " + sentence(rng, 90)).split()
    docs, want = [(i, sentence(rng, 150)) for i in range(100)], set()
    for i in range(50):
        t = list(text)
        if i % 2:
            t[40] = str(5001 + i)
        else:
            at = 95 + i
            t[at : at + 2] = [t[at] + t[at + 1]]
        docs.append((1000 + i, " ".join(t)))
        want.add((1000 + i, 1))
    assert found(spark, docs, items, shard_words=4000) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", 0, 0)], DOCS)
    items = spark.createDataFrame([(1, "dev", "a b c d e f g")], ITEMS)
    assert leaks.leaked_passages(docs.limit(0), items).count() == 0
    assert leaks.leaked_passages(docs, items.limit(0)).count() == 0
    assert leaks.leaked_passages(docs, items).count() == 0


def test_a_passage_that_travels_is_no_standard_wording(spark):
    """One passage in 1, 6, 7, 50 of 300 documents, and one under five ids; standard wording stands alone in many."""
    rng = random.Random(11)
    copies = {1: 1, 2: 6, 3: 7, 4: 50}
    items = [(i, "test", sentence(rng, 60)) for i in copies]
    shared = sentence(rng, 60)
    items += [(10 + i, "dev", shared) for i in range(5)]
    standard = sentence(rng, 30)
    items += [(20 + i, "dev", sentence(rng, 40) + " " + standard) for i in range(4)]
    docs, want = [], set()
    for i in range(300):
        docs.append([i, sentence(rng, 60), sentence(rng, 60)])
    for item, n in copies.items():
        for d in rng.sample(range(300), n):
            docs[d].insert(1, items[item - 1][2])
            want.add((d, item))
    for d in (5, 250):
        docs[d].insert(1, shared)
        want |= {(d, 10 + i) for i in range(5)}
    for d in rng.sample(range(300), 60):
        docs[d].insert(rng.randint(1, len(docs[d])), standard)
    docs[7].insert(1, items[-1][2])
    want.add((7, 23))
    assert found(spark, [(d[0], " ".join(d[1:])) for d in docs], items) == want


def test_hot_seeds_stay_within_memory():
    """One 6-gram in 10,000 places of a shard and in 2,000 passages: 20 million pairs, none of which is a leak."""
    rng = np.random.default_rng(2)
    hot = "for the year ended december 31".split()
    word = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    docs = [" ".join(word(12) + hot + word(12)) for _ in range(10_000)]
    passages = [word(10) + hot + word(20) for _ in range(2000)]
    docs[5] += " " + " ".join(passages[3][8:])
    row = next(pd.concat(leaks._shards(10**6)(iter([pd.DataFrame({"doc_id": range(10_000), "text": docs})]))).itertuples(index=False))
    hashed = leaks._Hasher()
    block = leaks._passages(list(range(2000)), [hashed(" ".join(p)) for p in passages])
    shard, pairs = leaks.Shard(row), 0
    for p, t, doc in shard.occurrences(block, block.window_starts(leaks.SEED_WORDS)):
        assert len(p) <= leaks.HELD + 100_000
        pairs += len(p)
    assert pairs < leaks.HOT
    sent = lambda v: type("Sent", (), {"value": v})()
    got = pd.concat(leaks._match_pass(sent(block), sent(np.zeros(len(block.words), bool)), 25)(iter([pd.DataFrame([row])])))
    assert [(r.doc_id, r.item) for r in got.itertuples()] == [(5, 3)]


def test_search_is_that_of_a_scan():
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 3, n))
    docs = [text(n) for n in (1, 5, 40, 300, 8)]
    row = next(pd.concat(leaks._shards(10**6)(iter([pd.DataFrame({"doc_id": range(5), "text": docs})]))).itertuples(index=False))
    shard, hashed = leaks.Shard(row), leaks._Hasher()
    block = leaks._passages([0, 1], [hashed(text(60)), hashed(text(30) + " other " + text(9))])
    query, places = shard.ranks_of(block.words), block.window_starts(8)
    for m in (6, 8):
        lower, upper = shard.search(query, places, m)
        for p, lo, up in zip(places, lower, upper):
            want = [t for t in range(len(shard.ranks) - m + 1) if list(shard.ranks[t : t + m]) == list(query[p : p + m])]
            assert sorted(shard.sa[lo:up]) == want


def sent(value):
    return type("Sent", (), {"value": value})()


def matches(docs, passages, shard_words=10**6, items_at_a_time=10**6):
    """(doc, item) pairs of the match pass, for texts as lists of words."""
    rows = pd.concat(leaks._shards(shard_words)(iter([pd.DataFrame({"doc_id": range(len(docs)), "text": [" ".join(d) for d in docs]})])))
    hashed, out = leaks._Hasher(), set()
    for i in range(0, len(passages), items_at_a_time):
        ids = list(range(len(passages)))[i : i + items_at_a_time]
        block = leaks._passages(ids, [hashed(" ".join(passages[k])) for k in ids])
        got = pd.concat(leaks._match_pass(sent(block), sent(np.zeros(len(block.words), bool)), 25)(iter([rows])))
        out |= {(r.doc_id, r.item) for r in got.itertuples()}
    return out


def test_leaks_do_not_depend_on_how_often_a_seed_is():
    """Runs of which one piece, or every piece, has no other seed than one in over a million pairs of a shard."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    hot = ["for the year ended december 31".split(), "in millions except per share data".split(), "see notes to consolidated financial statements".split()]
    passages = [word(15) + hot[0] + word(1) + hot[1] + word(1) + hot[2] + word(15) for _ in range(1100)]
    docs = [word(9) + hot[i % 3] + word(9) + (hot[(i + 1) % 3] if i < 100 else []) for i in range(3300)]
    # 13 words and, after an insertion, one hot seed between changed words
    p = passages[3]
    docs[5] = word(9) + p[2:15] + word(40) + p[15:21] + word(1) + p[22:27] + word(9)
    # three hot seeds, a word changed between two of them and an insertion before the third
    p = passages[8]
    docs[6] = word(9) + p[10:15] + p[15:21] + word(1) + p[22:28] + word(30) + p[28:35] + word(9)
    # three hot seeds alone
    p = passages[9]
    docs[7] = word(9) + p[15:21] + word(1) + p[22:28] + word(30) + p[29:35] + word(1) + p[36:41] + word(9)
    want = {(5, 3), (6, 8), (7, 9)}
    small = matches(docs, passages, shard_words=3000, items_at_a_time=100)
    assert want <= small
    assert matches(docs, passages) == small


def test_hot_seeds_are_complete_beside_others(monkeypatch):
    """Every pair with enough words under seeds has the same occurrences whatever counts as hot, and however many are held."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 2, n))
    docs = [text(n) for n in rng.integers(5, 40, 60)]
    row = next(pd.concat(leaks._shards(10**6)(iter([pd.DataFrame({"doc_id": range(60), "text": docs})]))).itertuples(index=False))
    shard, hashed = leaks.Shard(row), leaks._Hasher()
    block = leaks._passages(list(range(30)), [hashed(text(n)) for n in rng.integers(4, 30, 30)])

    def pairs():
        out = {}
        for p, t, doc in shard.occurrences(block, block.window_starts(leaks.SEED_WORDS)):
            assert len(p) == len(t) == len(doc)
            now = {}
            for x in zip(doc.tolist(), block.items()[p].tolist(), p.tolist(), t.tolist()):
                now.setdefault(x[:2], []).append(x[2:])
            assert not now.keys() & out.keys()
            out |= now
        assert all(len(v) == len(set(v)) for v in out.values())
        seeded = lambda v: len({i + k for i, _ in v for k in range(leaks.SEED_WORDS)})
        return {k: sorted(v) for k, v in out.items() if seeded(v) >= leaks.LEAST_SEEDED}

    want = pairs()
    assert len(want) > 100
    for hot, held in ((0, leaks.HELD), (20, leaks.HELD), (40, leaks.HELD), (0, 10), (20, 10)):
        monkeypatch.setattr(leaks, "HOT", hot)
        monkeypatch.setattr(leaks, "HELD", held)
        assert pairs() == want


def test_standard_wording_is_told_by_all_blocks_of_passages(spark, monkeypatch):
    """30 documents with a stretch and 30 with more of one passage around it: for the other passage 60 have it alone."""
    rng = random.Random(12)
    standard = sentence(rng, 30)
    items = [(i, "test", sentence(rng, 40) + " " + standard + " " + sentence(rng, 40)) for i in range(2)]
    longer = " ".join(items[0][2].split()[10:70])
    docs = [(i, sentence(rng, 60) + " " + (standard if i < 30 else longer if i < 60 else "") + " " + sentence(rng, 60)) for i in range(300)]
    want = {(i, 0) for i in range(30, 60)}
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_words=100) == want
    assert found(spark, docs, items, shard_words=2000) == want
    monkeypatch.setattr(leaks, "HELD", 500)
    assert found(spark, docs, items, shard_words=2000, block_words=100) == want
