"""The signature join, ranked search and token alignment against brute force, with odd rows and crowds."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mensura.llm import alignment, minhash_join, queries, ranked_search

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (7, "naïve café 東京 <s> </s> <|endoftext|>"), (8, "a" * 3000), (None, "one two"), (9, "x  y \r\n z ▁ w "), (9, "x  y")]


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, node string, token int")


def words(n, seed, kinds=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(kinds)}" for _ in range(n)]


def edited(text, share, seed):
    draw = random.Random(seed)
    return [f"e{draw.random()}" if draw.random() < share else w for w in text]


def brute_components(rows):
    sets = []
    for _, text in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(parts[i : i + 3]) for i in range(max(len(parts) - 2, min(len(parts), 1)))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if d is None else d)
    out = [(d, len(s), None if math.isinf(c := least[find(i)]) else c) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=str)


def crowd():
    """Near copies of one text, twins that share most of their words with all others, exact copies, and a chain of edits."""
    rows, base = list(ODD), words(300, 1)
    rows += [(100 + i, " ".join(edited(base, 0.012, i))) for i in range(60)]
    shared = words(260, 2)
    for i in range(30):
        own = shared + words(40, 1000 + i, 10**9)
        rows += [(300 + 2 * i, " ".join(own)), (301 + 2 * i, " ".join(own[:-3]))]
    rows += [(500 + i, " ".join(words(50, 3))) for i in range(40)]
    chain = words(200, 4)
    for i in range(25):
        rows.append((600 + i, " ".join(chain)))
        chain = edited(chain, 0.015, 50 + i)
    return rows


@pytest.mark.parametrize(("short_list", "rounds"), [(8, 2), (2, 0), (3, 1)])
def test_minhash_join_finds_all_links(spark, short_list, rounds):
    rows = crowd()
    got = minhash_join.minhash_duplicates(frame(spark, rows), short_list=short_list, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_minhash_join_of_nothing(spark):
    assert minhash_join.minhash_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in minhash_join.minhash_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_match_threshold():
    draw = np.random.default_rng(0)
    matches = minhash_join.least_matches()
    assert (draw.binomial(64, 0.85, 200_000) >= matches).all() and 20 < matches < 45


def brute_search(rows, items, k):
    texts = [(d, [t.decode() for t in ranked_search.terms_of(x or "")]) for d, x in rows]
    texts = [(d, t) for d, t in texts if t]
    n_docs, n_terms = len(texts), sum(len(t) for _, t in texts)
    df = Counter(t for _, ts in texts for t in set(ts))
    out = []
    for item, text in items:
        asked, scores = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))), []
        for d, ts in texts:
            tf, m = Counter(ts), 100 - 25 + (25 * len(ts) * n_docs) // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in asked.items() if tf[t])
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(item, r + 1, None if math.isinf(d) else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranked_search(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CHUNK", 64)
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    rows = list(ODD) + [(20 + i, " ".join(words(80, i, 300 if i % 2 else 60))) for i in range(300)] + [(1000 + i, "w1 w2 w3 W4,w5") for i in range(50)]
    items = [(1, "w1 w2 w2 W3-w299"), (2, None), (3, "unseen words"), (4, "w0 w1 w5 w7 w9 w11 w13"), (4, "w0 w1"), (None, "one TWO 東京"), (6, " ".join(words(40, 7, 300)))]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    for k in (1, 20):
        got = ranked_search.search(frame(spark, rows).repartition(5), asked, k=k).collect()
        assert sorted(map(tuple, got), key=str) == brute_search(rows, items, k)
    assert ranked_search.search(frame(spark, []), asked).collect() == [] == ranked_search.search(frame(spark, rows), asked.limit(0)).collect()


def test_summaries_bound_their_blocks_and_let_some_be_skipped():
    import pyarrow as pa

    draw = np.random.default_rng(3)
    kind = draw.integers(0, 8, 200)
    terms = [np.unique(np.concatenate(([0], 1 + 10 * k + draw.integers(0, 10, 6)))).astype(np.int32) for k in kind]
    impacts = [draw.integers(1, 900_000, len(t)).astype(np.int32) for t in terms]
    chunk = pa.table({"term": pa.array([0] * 200, pa.int32()), "chunk": pa.array([0] * 200, pa.int32()), "doc_id": pa.array(range(200), pa.int64()), "terms": terms, "impacts": impacts})
    found = ranked_search.blocked(chunk).to_pylist()
    assert sorted(i for b in found for i in b["ids"]) == list(range(200))
    weight = np.zeros(81, np.int64)
    weight[1:11] = 5
    exact = {i: int((weight[t] * v).sum()) for i, (t, v) in enumerate(zip(terms, impacts))}
    bounds = {k: int((weight[b["summary_terms"]] * np.array(b["summary"])).sum()) for k, b in enumerate(found)}
    assert all(bounds[k] >= exact[i] for k, b in enumerate(found) for i in b["ids"])
    tenth = sorted(exact.values())[-10]
    assert sum(v < tenth for v in bounds.values()) >= len(found) // 3


def test_essential_terms_cover_every_good_document():
    draw = np.random.default_rng(5)
    for _ in range(50):
        terms, bounds, df = np.arange(6), draw.integers(1, 50, 6), draw.integers(1, 50, 6)
        threshold = int(draw.integers(1, 120))
        kept = set(ranked_search.essential_terms(terms, bounds, df, threshold).tolist())
        assert sum(b for t, b in enumerate(bounds) if t not in kept) < threshold


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.SENTENCEPIECE_MODEL)
    letters = alignment.byte_letters()
    of_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return lambda t: (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)), of_a, of_b


def brute_alignment(texts, tokenizers):
    encode, of_a, of_b = tokenizers
    docs, counts = [], Counter()
    for text in texts:
        ids = encode(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a[i] for i in ids[0]) != whole or b"".join(of_b[i] for i in ids[1]) != whole:
            docs.append(None)
            continue
        sides = []
        for side, table in zip(ids, (of_a, of_b)):
            ends, at = [], 0
            for i in side:
                at += len(table[i])
                ends.append((at, i))
            sides.append(ends)
        both = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
        groups, last = [], 0
        for e in both:
            groups.append(tuple([i for at, i in side if last < at <= e] for side in sides))
            last = e
        links = Counter((a, b) for g in groups for a in g[0] for b in g[1])
        counts.update(links.keys())
        docs.append((ids, groups, links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, groups, links = d
        laid = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append(
            (len(ids[0]), len(ids[1]), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(laid.encode()).hexdigest())
        )
    return out


def test_alignment(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 64)
    monkeypatch.setattr(alignment, "BYTES_AT_ONCE", 2000)
    texts = [t for _, t in ODD] + ["\t tab  two\nnew\n\n  lines 　wide\xa0nbsp\x1cfs", "end ", " lead", " ", "  ", "日本語のテキスト、長い文。", "don't it's WE'LL 12345 1e-5", "▁▁ under", "😀😀 emoji é́ combining", "\x00 nul", "a  b   c", "= = == === ---- ____"]
    texts += [" ".join(words(60, s)) for s in range(20)] * 2 + ["".join(chr(random.Random(s).randrange(32, 0x3000)) for s in range(400))]
    for at_once in (1 << 20, 40):
        got = alignment.alignment(frame(spark, list(enumerate(texts))).repartition(3), queries.BYTE_LEVEL, queries.SENTENCEPIECE_MODEL, pairs_at_once=at_once).sort("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == brute_alignment(texts, tokenizers)
    assert alignment.alignment(frame(spark, []), queries.BYTE_LEVEL, queries.SENTENCEPIECE_MODEL).collect() == []


def test_op13(spark, tokenizers):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").sort("doc_id").collect()
    got = queries.op13_token_alignment(spark, "/root/testdata/sf0.001").sort("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_alignment([r.text for r in texts], tokenizers) and [r.doc_id for r in got] == [r.doc_id for r in texts]


def test_pointers_lead_to_the_end_of_the_group():
    a, b = np.array([3, 6, 9, 12, 13]), np.array([2, 4, 8, 10, 12, 13])
    groups = alignment.groups_of(a, b)
    assert groups[0].tolist() == [0, 0, 0, 0, 1] and groups[1].tolist() == [0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize(("shared", "short_list"), [(870, 8), (880, 2)])
def test_near_copies_in_crowds_are_all_found(spark, shared, short_list):
    """Texts that share most of their words, each with a twin of a resemblance of 0.83."""
    from mensura.llm.resembling import drop_near_copies

    common, rows = words(shared, 1, 10**9), []
    for i in range(80):
        own = common + words(1000 - shared, 100 + i, 10**9)
        twin = list(own)
        for k in range(5, 1000, 55):
            twin[k] = f"t{i}x{k}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(twin))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in drop_near_copies(frame, short_list=short_list).collect()) == [2 * i for i in range(80)]
