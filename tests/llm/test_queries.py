"""The registered corpus queries on the smallest tables against brute force and SQL."""

import hashlib
import html
import math
import re
import struct

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mensura.llm import importance, packing, pieces, queries
from mensura.llm.byte_pairs import PATTERN, load_ranks
from tests.llm.test_texts import brute_buckets, brute_classes, brute_fingerprint, brute_sketch, library, plain_best_fit  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def rows(table, columns, order):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet' ORDER BY {order}").fetchall()


@pytest.fixture(scope="module")
def documents():
    return rows("documents", "doc_id, text", "doc_id")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    found = queries.queries()[name](spark, FOLDER)
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = connection.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in found.select(*names).collect())


def test_op2(spark, documents):
    got = {r.doc_id: r for r in queries.op2_scaled_sketch(spark, FOLDER).collect()}
    order = sorted(documents, reverse=True)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = brute_sketch(text)
        a, b, c = (set(brute_sketch(t)[0]) for t in (text, edited, after))
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        digits = [f"{h & (1 << 64) - 1:016x}" for h in (own[0] or own[1:]) if h is not None]
        assert got[i].fingerprint == "~" * (not own[0] and bool(digits)) + "".join(digits)
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else float(own[1] == brute_sketch(edited)[1]))
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else float(own[1] == brute_sketch(after)[1]))


def test_op6(spark, documents):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    got = {r.doc_id: r for r in queries.op6_license_scan(spark, FOLDER).collect()}
    for i, text in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        places = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_op7(spark, documents, library):
    got = {r.doc_id: r for r in queries.op7_sentencepiece(spark, FOLDER).collect()}
    ids = {r.doc_id: r.ids for r in pieces.encode(spark.read.parquet(f"{FOLDER}/documents.parquet"), queries.SENTENCEPIECE_MODEL).collect()}
    assert set(got) == {i for i, _ in documents}
    for i, text in documents:
        assert (got[i].decoded_sha256, got[i].decoded_chars) == (hashlib.sha256(text.encode()).hexdigest(), len(text))
        assert ids[i] == library.encode(text) and got[i].n_pieces == len(ids[i])


def test_op8(spark):
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, FOLDER).collect()}
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, _, role, text in rows("conversations", "conv_id, turn, role, text", "conv_id, turn"):
        convs.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op9(spark, documents):
    prints = {i: brute_fingerprint(t) for i, t in documents}
    classes = brute_classes(set(prints.values()), 4)
    least = {}
    for i, p in prints.items():
        least[classes[p]] = min(i, least.get(classes[p], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, FOLDER).collect()}
    assert got == {(i, f"{p:016x}", least[classes[p]]) for i, p in prints.items()}


def test_op10_articles(spark):
    got = {r.page_id: r.text for r in queries.op10_html_text(spark, FOLDER).collect()}
    for i, page in rows("pages", "page_id, html", "page_id"):
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", article)]
        assert got[i] == "\n".join(b for b in blocks if b)


def spark_hash(seed, *values):
    """Spark's xxhash64 of longs, ints (as ``i``) and strings, signed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_op4(spark, documents):
    labels = {}
    for i, quality in rows("labels", "doc_id, quality", "doc_id"):
        labels.setdefault(i, set()).add(quality > 0)
    known = {i: q.pop() for i, q in labels.items() if len(q) == 1}
    fit = {i for i in known if spark_hash(42, struct.pack("<q", i), struct.pack("<i", 1)) % 2 == 0}
    grams = {i: brute_buckets(t) for i, t in documents}
    counts = np.zeros((2, 2, importance.BUCKETS))  # of all and of the target, by kind
    for i, kinds in grams.items():
        for kind, buckets in enumerate(kinds):
            np.add.at(counts[0, kind], buckets, 1)
            if i in fit and known[i]:
                np.add.at(counts[1, kind], buckets, 1)
    share = counts[1].sum(axis=1) / counts[0].sum(axis=1)
    ratios = np.round((np.log(counts[1] + 16) - np.log(counts[0] * share[:, None] + 16)) * 65536).astype(int)
    weights = {i: sum(int(ratios[kind][buckets].sum()) for kind, buckets in enumerate(kinds) if buckets) / 65536 for i, kinds in grams.items()}
    judged = [(weights[i], good) for i, good in known.items() if i not in fit and i in weights]
    edges = sorted({w for w, _ in judged})
    edges = [edges[0] - 1, *[(a + b) / 2 for a, b in zip(edges, edges[1:])], edges[-1] + 1]
    cost = [sum(importance.COST_OF_LOST_GOOD if good else 0 for w, good in judged if w < e) + sum(not good for w, good in judged if w >= e) for e in edges]
    wanted = sum(w >= edges[cost.index(min(cost))] for w in weights.values())
    keys = {}
    for i, t in documents:
        u = ((spark_hash(42, struct.pack("<q", i), t.encode(), struct.pack("<i", importance.SEED)) % (1 << 64) >> 11) + 0.5) / (1 << 53)
        keys[i] = math.floor((weights[i] - math.log(-math.log(u))) * (1 << 32))
    taken = set(sorted(keys, key=keys.get, reverse=True)[:wanted])
    got = {r.doc_id: r for r in queries.op4_importance_resampling(spark, FOLDER).collect()}
    assert set(got) == set(keys)
    for i, r in got.items():
        assert r.log_weight == weights[i] and abs(r.sample_key - keys[i]) < 1 << 16
    assert {i for i, r in got.items() if r.selected} == taken


def test_op4_accuracy(spark):
    """All labelled rows, of which half are used for the ratios and half for the cut."""
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = importance.importance_scores(documents, importance.fit_importance(documents, labels))
    judged = scores.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum((~F.col("selected")).cast("int")).alias("out"))
    got = {r.quality: (r.n, r.out) for r in judged.collect()}
    assert got[1][1] <= 0.001 * got[1][0] and got[0][1] >= 0.98 * got[0][0]


def tokens_of(text):
    encoding = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=load_ranks(queries.BYTE_PAIR_RANKS).of, special_tokens={})
    return [*encoding.encode_ordinary(text), 50256]


def documents_of(packed):
    """Tokens of every document, put together from the sequences that hold its pieces."""
    pieces_of = {}
    for r in packed:
        for p in r.pieces:
            pieces_of.setdefault(p.doc_id, []).append((p.piece, r.token_ids[p.bin_offset : p.bin_offset + p.tokens]))
    return {i: [t for _, ids in sorted(parts) for t in ids] for i, parts in pieces_of.items()}


def test_op3(spark, documents):
    packed = queries.op3_best_fit_packing(spark, FOLDER).collect()
    assert documents_of(packed) == {i: tokens_of(t) for i, t in documents}
    sizes = sorted((min(8192, len(ids) - k) for ids in documents_of(packed).values() for k in range(0, len(ids), 8192)), reverse=True)
    plain = plain_best_fit(sizes, packing.CAPACITIES)
    assert abs(sum(r.bin_capacity for r in packed) / sum(c for c, _ in plain) - 1) < 0.02 and len({r.bin_capacity for r in packed}) > 2


def resembling_classes(texts, least=0.8):
    """Least id of the class of each of the (id, text), from all pairs of five-word shingle sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if len(sets[a]) < least * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in sets}


def test_pipeline(spark, documents):
    folder_docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = importance.fit_importance(folder_docs, labels)
    good = {r.doc_id: r.text for r in importance.importance_sample(folder_docs, model).where("selected").collect()}
    kept = {}
    for i, t in good.items():
        kept[t] = max(i, kept.get(t, i))
    # the stage's contract: five-word shingles and a resemblance of 0.8 and more
    left = set(resembling_classes([(i, t) for t, i in kept.items()]).values())
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert documents_of(packed) == {i: tokens_of(t) for t, i in kept.items() if i in left}
    docs = folder_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == folder_docs.columns
