"""Operators on documents against brute force, with nulls, ties, long and empty texts."""

import hashlib
import itertools
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from mensura.llm import exact_dedup, fingerprints, importance, licenses, packing, pieces, simhash
from mensura.llm.components import connected_components

SCHEMA = "doc_id long, text string, row string, n long, grp string, note string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    long = words(rng, 30_000, 3000)
    base = words(rng, 300)
    texts = [None, "", "", " \n\t ", "A b", "a b", long, long, long + "x", base, base.replace("w1 ", "W1 ", 3), base + " tail", "é" * 70, "é" * 70 + "ß"]
    texts += [base[: 50 + k] for k in (0, 14, 15)] * 2 + [words(rng, 40) for _ in range(30)]
    docs = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    docs += [(None, "no id"), (None, base), docs[9], docs[9], docs[20]]
    return [(i, t, "r", 1, "g", None) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs, rows, empty):
    got = exact_dedup.exact_duplicates(docs, first_width=8, widening=16, max_width=1 << 16).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = {}
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            key = (i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())
            want[key] = want.get(key, 0) + 1
    seen, kept = {}, {}
    for r in got:
        key = (r.doc_id, r.keep_id, r.group_size, r.text_sha256)
        seen[key] = seen.get(key, 0) + 1
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + 1
    assert seen == want
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_drop_exact_duplicates(docs, rows, empty):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted({t or "" for _, t, *_ in rows})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def brute_fingerprint(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(found[k : k + 4]) for k in range(len(found) - 3)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(prints), 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash(docs, rows, empty):
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    classes = brute_classes({p for _, p in prints}, 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[classes[p]] = min(i, least.get(classes[p], i))
    want = sorted([(str(i), p, least.get(classes[p])) for i, p in prints], key=str)
    got = sorted([(str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == want
    left = simhash.drop_near_duplicates(docs).collect()
    assert len({classes[brute_fingerprint(r.text)] for r in left}) == len(set(classes.values()))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("short_list", [2, 64])
def test_simhash_links_of_a_crowd(spark, short_list):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    crowd = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(150)}
    crowd |= {rng.getrandbits(64) for _ in range(50)} | {0, 1}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in crowd]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), short_list=short_list)
    labels = {r.node & (1 << 64) - 1: r.label for r in connected_components(edges).collect()}
    classes = brute_classes(crowd, 4)
    for a, b in itertools.combinations(crowd, 2):
        together = a in labels and b in labels and labels[a] == labels[b]
        assert together == (classes[a] == classes[b])


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1000, k) for k in range(1001, 1100)]
    labels = {r.node: r.label for r in connected_components(spark.createDataFrame(path + star + [(5, 5), (7, 7)], "a long, b long")).collect()}
    assert len({labels[k] for k in range(61)}) == 1 and len({labels[k] for k in range(1000, 1100)}) == 1
    assert labels[0] != labels[1000] and len(labels) == 161


def brute_sketch(text):
    found = [w for w in re.split(r"\s+", (text or "").lower()) if w]

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def mix(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(int(v & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return signed(seed)

    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in found]
    every = {mix(hashes[k : k + 5]) for k in range(len(hashes) - 4)} or ({mix(hashes)} if hashes else set())
    return sorted(h for h in every if h < -(1 << 63) + (1 << 61)), min(every, default=None)


def test_fingerprints(docs, rows, empty):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((str(i), len(t), edited, brute_sketch(t), brute_sketch(edited), brute_sketch(after)))
    got = fingerprints.fingerprint_with_edits(docs).collect()
    got = [(str(r.doc_id), r.n_chars, r.edited_text, tuple(r.sketch), tuple(r.edited_sketch), tuple(r.next_sketch)) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint_with_edits(empty).count() == 0


def test_next_over_many_buckets(spark):
    ids = [3**k % 1_000_003 - 500_000 for k in range(400)] + [10**15]
    frame = spark.createDataFrame([(i, str(i)) for i in ids], "id long, v string").repartition(5)
    got = {r.id: r.next_v for r in fingerprints.with_next(frame, "id", ["v"], bucket_rows=7).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


def test_sketches_merge_and_contain(spark):
    rng = random.Random(8)
    small, rest = words(rng, 3000, 5000), words(rng, 30_000, 5000)
    frame = spark.createDataFrame([(small, rest, f"{small} {rest}", None)], "a string, b string, both string, none string")
    own = {c: fingerprints.sketch(F.coalesce(c, F.lit(""))) for c in frame.columns}
    row = frame.select(
        fingerprints.containment(own["a"], own["both"]).alias("in_both"),
        fingerprints.resemblance(own["a"], own["both"]).alias("alike"),
        fingerprints.resemblance(own["none"], own["none"]).alias("none"),
        fingerprints.containment(fingerprints.merge(own["a"], own["b"]), own["both"]).alias("merged"),
    ).first()
    assert row.in_both == 1.0 and row.merged == 1.0 and row.none == 1.0
    assert abs(row.alike - 1 / 11) < 0.03


def test_sketch_of_a_union_is_the_union_of_sketches(spark):
    """Of texts of any length, short ones that keep no hash too: their shingles are those of texts that share no border."""
    rng = random.Random(9)
    texts = [(words(rng, rng.randrange(0, 12)), words(rng, rng.randrange(0, 40))) for _ in range(60)]
    frame = spark.createDataFrame(texts, "a string, b string")
    got = frame.select("a", "b", fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m")).collect()
    short = 0
    for r in got:
        (x, p), (y, q) = brute_sketch(r.a), brute_sketch(r.b)
        short += not x and p is not None
        assert tuple(r.m) == (sorted({*x, *y}), min((h for h in (p, q) if h is not None), default=None))
    assert short > 5


def test_next_over_outlying_ids(spark):
    """A few far ids don't crowd all others into one bucket, and neither do null and equal ids lose rows."""
    ids = [*range(2000), 10**9, 10**15]
    frame = spark.createDataFrame([(i, str(i)) for i in ids], "id long, v string").repartition(5)
    got = {r.id: r.next_v for r in fingerprints.with_next(frame, "id", ["v"], bucket_rows=50).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain_best_fit(sizes, capacities):
    """The rule of packing, by looking at every bin and every waiting piece."""
    bins, placed = [], []  # capacity and tokens of each
    for k, size in enumerate(sizes):
        fits = [(c - u, n) for n, (c, u) in enumerate(bins) if c - u >= size]
        if fits:
            least = min(room for room, _ in fits)
            options = [n for room, n in fits if room == least]
        else:
            def a_token(c):
                waiting = sum(s for s in sizes[k + 1 :] if s <= c - size)
                return (c + c * c / 8192 + 128) / max(size + min(c - size, waiting), 1)

            bins.append([min((c for c in capacities if c >= size), key=lambda c: (a_token(c), c)), 0])
            options = [len(bins) - 1]
        placed.append((options, size))
        bins[options[-1]][1] += size  # any of them: rooms are the same
    return sorted((min(c for c in capacities if c >= u), u) for _, u in bins)


@pytest.mark.parametrize("capacities", [(16, 32, 64), (512, 1024, 2048, 4096, 8192), (100,)])
def test_best_fit_is_the_plain_rule(capacities):
    rng = random.Random(4)
    for _ in range(5):
        sizes = sorted((rng.randrange(0, capacities[-1] + 1) if rng.random() < 0.3 else rng.randrange(0, capacities[0]) for _ in range(300)), reverse=True)
        placed, bins = packing.best_fit(sizes, capacities), {}
        for size, (place, offset, final) in zip(sizes, placed):
            assert offset == bins.get(place, (final, 0))[1]
            bins[place] = (final, offset + size)
        plain = plain_best_fit(sizes, capacities)
        assert sum(u for _, u in bins.values()) == sum(u for _, u in plain) == sum(sizes)
        assert abs(len(bins) - len(plain)) <= 3 and abs(sum(c for c, _ in bins.values()) / sum(c for c, _ in plain) - 1) < 0.02
        assert all(u <= c and c == min(x for x in capacities if x >= u) for c, u in bins.values())


def test_several_capacities_cost_less_than_any_alone():
    rng = random.Random(8)
    sizes = sorted((min(int(rng.paretovariate(1.1) * 60), 8192) for _ in range(2000)), reverse=True)

    def total(capacities):
        return sum(packing.cost(c) for c in {place: final for place, _, final in packing.best_fit(sizes, capacities)}.values())

    opened = {final for _, _, final in packing.best_fit(sizes)}
    assert len(opened) >= 4 and total(packing.CAPACITIES) < total((8192,))
    for k in range(len(packing.CAPACITIES)):
        assert total(packing.CAPACITIES) <= 1.001 * total(packing.CAPACITIES[k:])  # a greedy rule


def test_pack(spark, docs, rows, empty):
    import tiktoken

    from mensura.llm.byte_pairs import PATTERN, load_ranks

    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=load_ranks(RANKS).of, special_tokens={"<|endoftext|>": 50256})
    capacities = (16, 64, 256)
    got = packing.pack(docs, RANKS, capacities=capacities, shard_bytes=2000).collect()
    made = {}
    for r in got:
        assert r.bin_tokens == len(r.token_ids) <= r.bin_capacity == min(c for c in capacities if c >= r.bin_tokens)
        at = 0
        for p in r.pieces:
            assert p.bin_offset == at and p.piece_start == 256 * p.piece
            made.setdefault((str(p.doc_id), p.piece), []).append(tuple(r.token_ids[at : at + p.tokens]))
            at += p.tokens
        assert at == r.bin_tokens
    want = {}
    for i, t, *_ in rows:
        ids = [*plain.encode_ordinary(t or ""), 50256]
        for k in range(0, len(ids), 256):
            want.setdefault((str(i), k // 256), []).append(tuple(ids[k : k + 256]))
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in want.items()}
    again = packing.pack(docs.repartition(3), RANKS, capacities=capacities, shard_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert packing.pack(empty, RANKS).count() == 0


def test_importance_sampling(spark):
    rng = random.Random(2)
    good = [words(rng, rng.randrange(20, 200)) for _ in range(300)]
    bad = [re.sub(r"w", "#$", words(rng, 80)) for _ in range(40)] + [f"w{k} " * 80 for k in range(40)]
    texts = [(t, 1) for t in good] + [(t, 0) for t in bad]
    rows = [(k, t, "r", 1, "g", None) for k, (t, _) in enumerate(texts)] + [(None, None, "r", 1, "g", None), (3, good[3], "r", 1, "g", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fitted = [k for k in range(len(texts)) if k % 2]
    labels = spark.createDataFrame([(k, texts[k][1]) for k in fitted] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = importance.fit_importance(docs, labels)
    picked = {r.doc_id: r.selected for r in importance.importance_sample(docs, model).collect()}
    held_out = [k for k in range(len(texts)) if k % 2 == 0]
    right = sum(picked[k] == bool(texts[k][1]) for k in held_out)
    assert right / len(held_out) > 0.97
    kept = [picked[k] for k in held_out if texts[k][1]]
    assert sum(kept) / len(kept) > 0.97

    taken = importance.importance_sample(docs, model, k=25)
    keys = sorted((r.sample_key for r in taken.collect()), reverse=True)
    assert sorted((r.sample_key for r in taken.where("selected").collect()), reverse=True) == [k for k in keys if k >= keys[24]]
    assert importance.importance_sample(docs, model, k=0).where("selected").count() == 0
    assert importance.importance_sample(docs, model, k=10**6).where("not selected").count() == 0
    left = importance.drop_low_quality(docs, labels)
    assert left.columns == docs.columns and left.count() < len(rows)
    assert importance.drop_low_quality(docs, labels.limit(0)).count() == len(rows)
    assert importance.drop_low_quality(docs.limit(0), labels).count() == 0


def brute_buckets(text):
    """Buckets of the runs of four bytes and of the word pairs of a text, one by one."""
    data, base, mod = text.encode(), 0x9E3779B97F4A7C15, 1 << 64
    runs = [(int.from_bytes(data[i : i + 4], "little") * 2654435761 % (1 << 32)) >> 16 for i in range(len(data) - 3)]
    hashes = [sum(c * pow(base, k, mod) for k, c in enumerate(w)) % mod for w in re.split(rb"[\x00-\x20]+", data) if w]
    pairs = [0 if x == y else max((x * base % mod ^ y) * 0xC2B2AE3D27D4EB4F % mod % 4096, 1) for x, y in zip(hashes, hashes[1:])]
    return runs, pairs


@pytest.mark.parametrize("piece", [1, 7, 64, 1000, 1 << 20])
def test_weights_lose_no_gram_in_long_texts(piece):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    texts = [words(rng, rng.randrange(0, 300)) for _ in range(30)] + ["", "x", "ab", "x" * 500, " ", "  a  b ", "é" * 77, words(rng, 40) + "y" * 200 + " " + words(rng, 5)]
    ratios = np.random.default_rng(1).integers(-(1 << 20), 1 << 20, (2, importance.BUCKETS))
    want = [sum(int(ratios[kind][b]) for kind, buckets in enumerate(brute_buckets(t)) for b in buckets) / (1 << 16) for t in texts]
    assert importance._weigh(pa.array(texts), ratios, piece).tolist() == want
    assert importance._weigh(pa.array(["zz", *texts]).slice(1), ratios, piece).tolist() == want
    counts, brute = np.zeros((2, importance.BUCKETS), np.int64), np.zeros((2, importance.BUCKETS), np.int64)
    importance._count(pa.array(texts), counts, piece)
    for t in texts:
        for kind, buckets in enumerate(brute_buckets(t)):
            np.add.at(brute[kind], buckets, 1)
    assert (counts == brute).all()


def test_kth_largest(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 50), 1 << 50) for _ in range(200)] + [5] * 20 + [-1, 0, (1 << 62)]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    order = sorted(keys, reverse=True)
    for k in (1, 2, 100, len(keys)):
        assert importance.kth_largest(frame, k) == order[k - 1]
    assert importance.kth_largest(frame, len(keys) + 1) is None


def test_licenses(spark):
    filler = "then others came to see what it was "
    texts = {
        1: filler * 30 + "Released UNDER the-MIT license. " + filler * 40,
        2: "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in it",
        3: "Licensed under CC BY-NC 4.0. Apache License, Version 2. cc by nc",
        4: filler * 50,
        5: "under the mit license" * 2,
        6: None,
        7: "This work is licensed under the GNU General Public License, version 3.",
        8: "under mit the license apache",
        9: "a student under license at the mit, and cc to nc by mail" + filler * 9,
        10: filler * 500 + dict(licenses.TEMPLATES)["mit"].replace("Software", "software!") + filler * 300,
    }
    rows = [(i, t, "r", 1, "g", None) for i, t in texts.items()] + [(None, "under the mit license", "r", 1, "g", None)] * 2
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 11
    assert (got[1].n_base, got[1].base_labels, got[1].labels, got[1].score) == (1, "mit", "mit", 1.0)
    assert got[1].first_word == got[1].last_word == 30 * 8 + 1
    assert got[2].n_base == 0 and got[2].labels == "mit" and 0.8 <= got[2].score <= 1
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (3, 2, 11, "apache-2,cc-by-nc")
    assert (got[4].labels, got[4].score, got[4].first_word) == ("", 0.0, None)
    assert got[5].n_base == 0 and got[5].n_words == 7 and got[5].labels == ""  # no phrase, and too short for a template
    assert (got[6].n_words, got[6].n_base, got[6].labels) == (0, 0, "")
    assert got[7].labels == "gpl-3"
    assert got[8].n_base == 0 and got[8].labels == "" and got[9].labels == ""
    assert got[10].labels == "mit" and got[10].n_base == 0 and got[10].score >= 0.9
    assert got[None].base_labels == "mit"
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_join_finds_every_pair(spark):
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(40)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randrange(2, 20)))) for k in range(12)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs, templates=templates, phrases=[], block_words=16).collect()}
    for k, text in enumerate(texts):
        found, want = text.split(), set()
        for label, template in licenses.template_blocks(templates, 16):
            for at in range(0, max(1, len(found)), 8):
                if len({w.encode() for w in found[at : at + 16]} & set(template)) >= math.ceil(0.8 * len(template) - 1e-9):
                    want.add(label)
        assert got[k] == ",".join(sorted(want))


@pytest.fixture(scope="module")
def library():
    """The library with a unigram model of the same pieces, scores and bars."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    used = [piece for piece in model.pieces if piece.type == 1]
    least = min(piece.score for piece in used if piece.score > -1e8)
    for piece in used:
        if piece.score < -1e8 and len(piece.piece) > 1:
            piece.type = 5
        else:
            piece.score = round(-math.log(2 - max(piece.score, least)) * 32) / 32
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def odd_texts():
    rng = random.Random(12)
    return [
        *("".join(rng.choice("abcde fgh,.\né漢=-") for _ in range(rng.randrange(200))) for _ in range(80)),
        "".join(rng.choice("abcdefgh") for _ in range(700)),
        " " * 300 + "x" + " " * 300,
        "literal  \uffff 漢字 \U0001f600 \n\t" * 20,
        "=" * 500,
        "-" * 333 + " " + "hahaha" * 60,
        "ab " * 100,
        "",
    ]


@pytest.mark.parametrize(("chunk_chars", "block_chunks"), [(16, 2), (40, 3), (97, 64), (1 << 14, 64)])
def test_pieces_are_those_of_the_library_for_any_chunks(spark, library, chunk_chars, block_chunks):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = pieces.encode(docs, MODEL, chunk_chars=chunk_chars, block_chunks=block_chunks)
    got = {r.doc_id: r for r in encoded.withColumn("text", pieces.decoder(MODEL)("ids")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].text == text
        assert got[i].ids == library.encode(text)
        assert got[i].n_chunks == (max(1, (len(text) + 1) // chunk_chars) if len(text) + 1 >= 2 * chunk_chars else 1)


def test_pieces(docs, rows, empty):
    for chunk_chars in (64, 1 << 14):
        got = pieces.encode(docs, MODEL, chunk_chars=chunk_chars).withColumn("text", pieces.decoder(MODEL)("ids")).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert pieces.encode(empty, MODEL).count() == 0


def test_pieces_of_literal_space_marks(spark):
    docs = spark.createDataFrame([(1, "a▁b " * 100)], "doc_id long, text string")
    for chunk_chars in (20, 1 << 14):
        assert pieces.encode(docs, MODEL, chunk_chars=chunk_chars).select(pieces.decoder(MODEL)("ids").alias("t")).first().t == "a▁b " * 100


def test_max_plus_is_associative():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b, c = rng.integers(-9, 9, (3, 4, 4))
    assert (pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))).all()


@pytest.mark.parametrize("short_list", [2, 16])
def test_pipeline_drops_copies_of_eight_tenths(spark, short_list):
    import corpus_pipeline
    from mensura.llm import resembling

    rng = random.Random(7)
    rows = []
    for k in range(20):
        words = [str(rng.randrange(10**6)) for _ in range(300)]
        rows.append((1000 * k, " ".join(words)))
        for c in range(1, 6):
            edited = list(words)
            for place in rng.sample(range(300), 3 * c):
                edited[place] = "X"
            rows.append((1000 * k + c, " ".join(edited)))
    rows += [(90001, None), (90002, ""), (90003, "few words"), (None, "Few  words")]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            label = [label[i] if x == label[j] else x for x in label]
    want = {min(rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None) for x in set(label)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in resembling.drop_near_copies(frame, short_list=short_list).collect()) == sorted(want)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == sorted(want)
    assert resembling.drop_near_copies(frame.limit(0)).count() == 0


def test_links_of_the_index_stay_where_signatures_disagree(spark, monkeypatch):
    from mensura.llm import minhash_join, resembling

    # as if chance had it that signatures of near copies agree too seldom
    for module in (resembling, minhash_join):
        monkeypatch.setattr(module, "least_matches", lambda resemblance: minhash_join.COORDINATES)
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(400)]
    hashes = resembling.shingles(" ".join(words))
    rows = [(0, " ".join(words))]
    for place in range(5, 395, 10):
        text = " ".join([*words[:place], "X", *words[place + 1 :]])
        few = bin((simhash.fingerprint(text, 5) ^ simhash.fingerprint(rows[0][1], 5)) & (1 << 64) - 1).count("1") <= 4
        if few and (minhash_join.signature(resembling.shingles(text)) != minhash_join.signature(hashes)).any():
            rows.append((place, text))
    assert len(rows) > 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in resembling.drop_near_copies(frame).collect()] == [0]


def clashing(spark):
    """Documents whose other columns have names that operators use inside."""
    names = "row at text_hash _sha _hash _id _n grp n digit size carried doc kept least label hash fp".split()
    texts = [(1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (3, None), (3, ""), (None, "nine ten")]
    return spark.createDataFrame([(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(texts)], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))


def test_stages_keep_clashing_columns(spark):
    from mensura.llm import resembling

    docs = clashing(spark)
    exact = exact_dedup.drop_exact_duplicates(docs)
    assert exact.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "", r["_sha"][:4]) for r in exact.collect()), key=str)
    assert [(i, t) for i, t, _ in got] == [(2, "one two three four five six seven eight"), (3, ""), (None, "nine ten")]
    for drop in (simhash.drop_near_duplicates, resembling.drop_near_copies):
        left = drop(docs)
        assert left.columns == docs.columns
        assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == [(1, "one two three four five six seven eight"), (3, ""), (None, "nine ten")]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert importance.drop_low_quality(docs, labels).columns == docs.columns
