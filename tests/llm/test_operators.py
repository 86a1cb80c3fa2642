"""Operators on a small table of hard rows, against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ripplekit.llm import attention, boosting, language, licenses, lm_scoring, mixing, packing, quality_rules, quality_vote, search, sharding, simhash, textstats, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = "the quick brown fox jumps over the lazy dog and runs into the deep green forest of tall trees near river "
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "Hello", "en", "b"), (5, SENTENCE * 3, "en", "b"), (6, SENTENCE * 3, "en", "b"), (6, SENTENCE * 3, "en", "b"),
    (7, "line one two three four five six seven\nline one two three four five six seven\n\n\nend!", "en", "c"), (8, "ünïcödé wörter über straße und größe für alle leute hier und dort", "de", "c"),
    (9, "der schnelle braune fuchs springt über den faulen hund und läuft davon in den wald", "de", "c"), (10, "*** $$$ ### %%% &&& || <> 12345", "en", None), (None, "no id here but some words all the same", "fr", "c"),
    (11, "x" * 3000, "en", "a"), (12, "word " * 30_000, "en", "a"), (13, "Released under the MIT License.", "en", "a"), (14, "le renard brun saute par dessus le chien paresseux et court dans la forêt", "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("fp", "key", "size", "score", "h", "found", "words", "n", "slot", "copies"):
        rows = rows.withColumn(clash, F.lit("clash"))
    return rows.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 10), 0) for i in range(4, 15)] + [(5, None, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")


def test_statistics_against_plain_python():
    for _, text, _, _ in ROWS:
        w = words(text)
        wins = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert textstats.describe(text)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover))


def test_repeats_stay_exact_with_many_words():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.arange(9000), rng.integers(0, 9000, 50), np.arange(100, 120)])
    wins = collections.Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4))
    want = len({j for i in range(len(ids) - 4) if wins[tuple(ids[i : i + 5])] > 1 for j in range(i, i + 5)})
    assert textstats.repeated_words(ids, 9000) == want


def test_trees_keep_monotone_directions():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.random(800) > 0.6).astype(float)
    trees = boosting.fit(x, y, np.array([1, -1, 0]), trees=30)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.9
    for k, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:1], 50, axis=0)
        grid[:, k] = np.linspace(0, 1, 50)
        assert (sign * np.diff(trees.margin(grid)) >= -1e-12).all()


def test_quality_rules_on_hard_rows(docs, none, labels):
    rows = quality_rules.rate(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in rows)
    assert quality_rules.rate(none, labels).count() == 0
    assert quality_rules.rate(docs, labels.where("false")).where(F.col("kept") == F.col("base_failed")).count() == 0
    assert quality_rules.kept_documents(docs, labels).columns == docs.columns


def test_quality_votes_on_hard_rows(docs, none, labels):
    model = quality_vote.train(docs, labels, F.lit(True))
    rows = quality_vote.vote(docs, model, ["doc_id"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_vote.vote(none, model, ["doc_id"]).count() == 0
    empty = quality_vote.train(docs, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality_vote.vote(docs, empty, ["doc_id"]).collect()} == {1.0}


def test_votes_equal_a_plain_cosine_search(docs, labels):
    model = quality_vote.train(docs, labels, F.lit(True))
    raw = quality_vote.raw_vectors([r[1] for r in ROWS], quality_vote.Terms())
    latent = model.project(model.terms(raw))
    for q, got in zip(latent, model.score(raw)):
        near = np.round(model.vectors @ q, 6)
        top = sorted(range(len(near)), key=lambda i: (-near[i], i))[: quality_vote.K]
        w = [math.exp(quality_vote.SHARPNESS * (float(near[i]) - 1)) * model.weights[i] for i in top]
        assert abs(got - sum(a * model.labels[i] for a, i in zip(w, top)) / sum(w)) < 1e-3


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abb"])}
    prob = np.random.default_rng(2).random((len(pieces) + 2, 2)) * 0.2
    prob[-2] = 0

    def brute(text, lang):
        if not text:
            return 1.0
        total = 0.0
        for k in range(1, len(text) + 1):
            p = pieces.get(text[:k], len(pieces) + 1 if k == 1 else None)
            if p is not None:
                total += prob[p, lang] * brute(text[k:], lang)
        return total

    table = language.PieceTable(pieces)
    for word in ("a", "abb", "abbaab", "xaby", "é" * 12):
        got = language.forward(language.lattice([word], table), prob)[0]
        assert np.allclose(got, [math.log(brute("▁" + word, k)) for k in (0, 1)])


def test_language_on_hard_rows(docs, none):
    model = language.train(docs)
    assert model[0] == ["de", "en", "fr"]
    rows = {r["doc_id"]: r for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 10))
    assert (rows[9]["lang_pred"], rows[14]["lang_pred"], rows[5]["lang_pred"]) == ("de", "fr", "en")
    assert language.identify(none, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none), ["doc_id"]).collect()} == {"und"}
    kept = language.identified_documents(docs, docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (1, 2, 3, 10)").count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(4)
    w = {n: v.astype(np.float64) for n, v in attention.new_weights(4, 5, rng).items()}
    x, y = rng.integers(0, attention.LEAVES, (2, attention.WINDOW)), rng.integers(0, attention.LEAVES, (2, attention.WINDOW))
    use = rng.random(x.shape) < 0.5
    _, grad = attention.loss_and_gradients(w, x, y, use)
    for name, at in (("Q", (1, 2)), ("V", (0, 3)), ("A", (2, 1)), ("E", (x[0, 5], 1)), ("P", (3, 2)), ("l", (int(y[use][0]) // attention.SLOTS, 3)), ("U", (1, 7))):
        old, loss = w[name][at], []
        for d in (1e-5, -1e-5):
            w[name][at] = old + d
            loss.append(attention.loss_and_gradients(w, x, y, use)[0])
        w[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-5 - grad[name][at]) < 1e-5


def test_windows_score_each_id_once_and_see_no_future():
    rng = np.random.default_rng(5)
    stream = np.append(rng.integers(0, 500, 70), 600)
    x, y, good, _ = attention.windows([stream], 600)
    assert y[good].tolist() == stream.tolist()
    model = attention.train([stream, stream], np.bincount(stream, minlength=50_257).astype(float), 600, steps=3, batch=2)
    other = x.copy()
    other[:, -1] = 7  # the last input may only change the last prediction
    a, b = (model.leaf_logs(model.of[v], model.of[y[:, attention.CONTEXT :]]) for v in (x, other))
    assert np.allclose(a[:, :-1], b[:, :-1])


def test_next_id_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    stream = np.append(rng.integers(0, 3000, 200), 600)
    model = attention.train([stream], np.bincount(stream, minlength=50_257).astype(float), 600, steps=5, batch=4)
    x = model.of[attention.windows([stream], 600)[0][:1]]
    ids = np.arange(50_257)
    logs = np.array([model.leaf_logs(x, np.full((1, attention.SCORED), leaf))[0, 5] for leaf in range(attention.LEAVES)])
    assert abs(np.exp(logs[model.of[ids]] + model.inside[ids]).sum() - 1) < 1e-3


def test_lm_scores_on_hard_rows(docs, none):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = lm_scoring.score(docs, held, train_docs=20).collect()
    counts = collections.Counter()
    split = {}
    for i, text, _, _ in ROWS:
        split[i] = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(text)]
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update([*split[i], None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(ROWS)
    for r in rows:
        ws = [*split[r["doc_id"]], None]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, -want) and r["score"] < 0
    assert lm_scoring.score(none, held, train_docs=20).count() == 0


def test_weights_learn_from_documents_beyond_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(10)
    cycle = [f"{a}{b}" for a in "bdfg" for b in "aeiou"]
    texts = [" ".join(cycle[(k + i) % len(cycle)] for i in range(600)) for k in rng.integers(0, len(cycle), 300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)

    def mean():
        scored = lm_scoring.score(df, F.col("doc_id") % 10 == 0, train_docs=0).where("held_out")
        return scored.agg(F.sum("score") / F.sum("n_tokens")).head()[0]

    learned = mean()
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0, raising=False)
    assert learned > mean() + 0.1


def test_search_against_all_products(spark):
    rng = np.random.default_rng(7)
    v = [(int(i), [float(x) for x in rng.normal(size=20)]) for i in range(0, 400)]
    v += [(400, v[50][1]), (401, v[50][1]), (402, None), (403, [float("nan")] * 20), (404, [1.0, None]), (450, [0.5] * 3), (500, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    ok = {i: np.floor(256 * np.float32(x).astype(float)).astype(int) for i, x in v if i is not None and x and all(y is not None and math.isfinite(y) for y in x)}
    full = {i: np.pad(x, (0, 20 - len(x))) for i, x in ok.items()}
    for size in (1 << 20, 700):
        got = collections.defaultdict(list)
        for r in search.nearest(df, F.col("vec_id") % 50 == 0, 5, query_bytes=size).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert set(got) == {i for i in full if i % 50 == 0}
        for q, rows in got.items():
            assert rows == [(i, int(s)) for s, i in sorted((-int(full[q] @ x), i) for i, x in full.items() if i != q)[:5] for s in [-s]]
    assert search.nearest(df.where("false"), F.lit(True)).count() == 0


def test_ids_equal_the_json_tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = tokens.encoder(tokens.rank_path())
    for text in [r[1] or "" for r in ROWS] + ["a  b   c \n d\n\n e\t f ", "漢字 <|endoftext|> it's 'll x ​"]:
        assert enc.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_hilbert_keys_are_a_path_of_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert((grid + 0.5) / 2 - 1, bits=2)
    assert sorted(keys) == list(range(64))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_is_whole_gapless_and_unpadded(docs, none):
    rows = packing.pack(docs, length=64).collect()
    want = collections.Counter(tuple([*tokens.encoder(tokens.rank_path()).ids(text).tolist(), 1]) for _, text, _, _ in ROWS)
    sequences = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["sequence_id"], r["offset"], r["start"], ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    got = collections.Counter()
    for pieces in by_doc.values():
        text = []
        for _, _, start, ids in sorted(pieces, key=lambda p: p[:2]):
            if start == 0 and text:
                got[tuple(text)] += 1
                text = []
            text += ids.tolist()
        got[tuple(text)] += 1
    assert got == want
    assert packing.pack(none).count() == 0


def test_sharding_balances_bytes_and_edits_its_map(spark, docs, none, tmp_path):
    rows = sharding.shard_documents(docs, 3, 256, str(tmp_path / "map")).collect()
    assert len(rows) == len(ROWS)
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    texts = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == texts
    loads = {s: int(x) for s, x in enumerate(np.random.default_rng(8).integers(1, 100, 256))}
    where = sharding.first_map(loads, 8, 256)
    held = [sum(loads[s] for s in range(256) if where[s] == k) for k in range(8)]
    assert max(held) - min(held) <= 100
    grown = sharding.rebalanced(where, loads, 9)
    held = [sum(loads[s] for s in range(256) if grown[s] == k) for k in range(9)]
    assert max(held) <= 1.02 * sum(held) / 9 and sum(a != b for a, b in zip(where, grown)) < 60
    maps = sharding.SlotMap(spark, str(tmp_path / "map"))
    maps.save(2, grown)
    assert maps.shards(2) == grown and len(maps.shards(1)) == 256
    assert sharding.shard_documents(none, 3, 256, str(tmp_path / "none")).count() == 0


def test_licenses_on_hard_rows(spark, docs, none):
    text = "Filler words come first here. " * 5 + licenses.TEMPLATES[1][1].replace("free of charge", "free") + " More filler words follow at the end."
    more = spark.createDataFrame([(20, text), (21, "this work is licensed under the gnu general public license version 3 " * 2), (22, "ALL RIGHTS RESERVED")], "doc_id long, text string")
    found = {(r["doc_id"], r["license"], r["template"]) for r in licenses.scan(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert found == {(13, "MIT", 0), (20, "MIT", 1), (21, "GPL-3.0", 4), (22, "proprietary", 12)}
    assert licenses.scan(none).count() == 0
    assert licenses.scan(docs, templates=()).count() == 0


def test_mix_against_a_plain_queue(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = {"a": 0, "b": 0, "c": 0, None: 0}
    for _, text, _, source in ROWS:
        sizes[source] += len(words(text))
    total, weight = sum(sizes.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    target, free = {}, dict(weight)
    left = float(total)
    while free:  # plain resharing, round by round
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del free[s]
    assert {(r["source_size"], round(r["target"], 6)) for r in rows} == {(sizes[s], round(target[s], 6)) for s in sizes}
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows) and sum(r["taken"] for r in rows) <= total
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def brute_fingerprint(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints_against_plain_python(spark):
    for _, text, _, _ in ROWS:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    native = spark.sql("SELECT xxhash64('the quick brown')").head()[0]
    assert xxhash.xxh64_intdigest(b"the quick brown", 42) == native % 2**64


def test_links_join_everything_within_three_bits(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for bits in (1, 2, 3, 3, 3, 4, 5):
            fps.append(int(b) ^ sum(1 << int(k) for k in rng.choice(64, bits, replace=False)))
    fps = np.unique(np.array(fps, np.uint64))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, len(fps))
    assert all(bin((r["a"] ^ r["b"]) % 2**64).count("1") <= 3 for r in edges.collect())
    root = {r["fp"]: r["root"] for r in simhash.groups(edges).collect()}
    got = collections.defaultdict(set)
    want = collections.defaultdict(set)
    for i, x in enumerate(fps.view(np.int64)):
        got[root.get(int(x), int(x))].add(int(x))
        want[find(i)].add(int(x))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_on_hard_rows(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    root = collections.defaultdict(set)
    for r in rows:
        root[r["doc_id"]].add(r["component_id"])
    assert root[5] == root[6] == {5} and root[1] == root[2] == root[3] == {1} and root[7] == {7}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6 OR doc_id = 2").count() == 0 and kept.where("doc_id = 5").count() == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_rows_that_share_an_id_or_have_none_count_apart(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (3, texts[4]), (7, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], texts.index(r["text"])) for r in simhash.one_of_each(df).collect()), key=str)
    assert kept == sorted([(None, 0), (None, 1), (7, 2), (7, 3), (3, 4)], key=str)
