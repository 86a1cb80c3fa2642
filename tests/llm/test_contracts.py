"""What the registered queries promise, on small tables of hard rows, against plain Python."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplekit.llm import attention, common, language, licenses, lm_scoring, mixing, packing, quality_rules, queries, sharding, simhash, textstats, tokens

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def prose(rng, n):
    return " ".join(f"{a}{b}" for a, b in zip(rng.choice(["the", "run", "green", "tall", "river"], n), rng.integers(0, 500, n)))


def test_a_model_scores_as_a_plain_masked_attention_does():
    rng = np.random.default_rng(20)
    streams = [np.append(rng.integers(0, 3000, n), 600) for n in (0, 1, 35, 36, 100)]
    model = attention.train(streams, np.bincount(np.concatenate(streams), minlength=50_257).astype(float), 600, steps=20, batch=4)
    w = {n: v.astype(np.float64) for n, v in model.weights.items()}
    d, softmax = w["Q"].shape[1], lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    scale = lambda v: v / math.sqrt((v**2).mean() + attention.EPS)
    for got, ids in zip(model.score(streams), streams):
        want = 0.0
        inputs = [600, *ids[:-1]]
        for first in range(0, len(ids), attention.SCORED):
            seen = [600] * max(0, attention.CONTEXT - first) + list(inputs[max(0, first - attention.CONTEXT) : first + attention.SCORED])
            h0 = [w["E"][model.of[t]] + w["P"][i] for i, t in enumerate(seen)]
            n0 = [scale(h) for h in h0]
            for i in range(attention.CONTEXT, len(seen)):
                a = softmax(np.array([(n0[i] @ w["Q"]) @ (n0[j] @ w["K"]) / math.sqrt(d) for j in range(i + 1)]))
                h1 = h0[i] + sum(p * (n @ w["V"]) for p, n in zip(a, n0)) @ w["O"]
                h2 = scale(h1 + np.maximum(scale(h1) @ w["A"], 0) @ w["B"])
                goal = int(ids[first + i - attention.CONTEXT])
                group, slot = divmod(int(model.of[goal]), attention.SLOTS)
                want += math.log(softmax(h2 @ w["U"] + w["u"])[group]) + math.log(softmax(h2 @ w["L"][group] + w["l"][group])[slot]) + float(model.inside[goal])
        assert abs(got - want / math.log(10)) < 1e-3 * max(1, abs(got))


def test_words_are_encoded_alone_whatever_stands_beside_them():
    path = lm_scoring.rank_path()
    plain = [b"one", b"two,", b"\xc2\xa0x", "ü ".encode(), " ü".encode(), b"a\xc2\xa0", b"b" * 500]
    for words in (plain[:2], plain):
        ids, first = lm_scoring.encode_words(words, path)
        edge = [*first.tolist(), len(ids)]
        for w, a, b in zip(words, edge, edge[1:]):
            assert ids[a:b].tolist() == tokens.encoder(path).ids(" " + w.decode()).tolist()


def test_equal_texts_score_alike_and_windows_follow_the_share():
    rng = np.random.default_rng(21)
    streams = [np.append(rng.integers(0, 3000, 4000), lm_scoring.END) for _ in range(20)]
    of = np.arange(lm_scoring.VOCAB) % attention.LEAVES
    size = 2 * 2 * attention.WINDOW
    rounds = lm_scoring.picked_windows(streams, of, 0.25, 3)
    total = sum(-(-len(s) // attention.SCORED) for s in streams)
    for own in rounds:
        assert 0.2 * total < sum(len(b or b"") // size for b in own) < 0.3 * total
    whole = lm_scoring.picked_windows(streams, of, 1.0, 1)[0]
    rows = np.frombuffer(whole[0], "<i2").reshape(-1, 2, attention.WINDOW)
    assert rows[:, 1][rows[:, 1] >= 0].tolist() == of[streams[0]].tolist()


def test_rounds_learn_from_every_training_window():
    rng = np.random.default_rng(22)
    streams = [np.append(rng.integers(0, 3000, 2000), lm_scoring.END) for _ in range(5)]
    of, k = np.arange(lm_scoring.VOCAB) % attention.LEAVES, lm_scoring.ROUNDS
    share = getattr(lm_scoring, "round_share", lambda n: lm_scoring.WINDOWS / n + lm_scoring.SHARE)(10**9)
    rounds = lm_scoring.picked_windows(streams, of, share, k)
    size = 2 * 2 * attention.WINDOW
    for i, s in enumerate(streams):
        got = [own[i][at : at + size] for own in rounds if own[i] for at in range(0, len(own[i]), size)]
        whole = lm_scoring.picked_windows([s], of, 1.0, 1)[0][0]
        assert sorted(got) == sorted(whole[at : at + size] for at in range(0, len(whole), size))


def test_windows_are_cut_for_each_round_and_none_is_stored_or_left_out(spark):
    rng = np.random.default_rng(23)
    rows = [(k, k % 3 == 0, " ".join(f"w{n}" for n in rng.integers(0, 500, 200 * (k % 4)))) for k in range(12)]
    texts = lm_scoring.read_texts(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), lm_scoring.rank_path(), {}, (1, 0.0))
    assert texts.columns[-1] == "ids"
    of, k = np.arange(lm_scoring.VOCAB) % attention.LEAVES, lm_scoring.ROUNDS
    size, got, want = 2 * 2 * attention.WINDOW, [], []
    for n in range(k):
        for r in lm_scoring.round_windows(texts, of, lm_scoring.round_share(10**9), k, n).collect():
            got += [bytes(r["w"][at : at + size]) for at in range(0, len(r["w"]), size)]
    for _, held_out, text in rows:
        if not held_out:
            w = lm_scoring.picked_windows([lm_scoring.sequence(lm_scoring.split(text), lm_scoring.rank_path())], of, 1.0, 1)[0][0]
            want += [w[at : at + size] for at in range(0, len(w), size)]
    assert sorted(got) == sorted(want)


def test_training_steps_on_weights_in_one_row_equal_plain_steps():
    rng = np.random.default_rng(24)
    plain = {n: v.astype(np.float64) for n, v in attention.new_weights(4, 5, rng).items()}
    adam = attention.Adam({n: v.copy() for n, v in plain.items()}, warm=3)
    first, second = ({n: np.zeros_like(v) for n, v in plain.items()} for _ in range(2))
    for t in range(1, 7):
        x, y = rng.integers(0, attention.LEAVES, (2, 3, attention.WINDOW))
        use = rng.random(x.shape) < (0 if t == 4 else 0.4)
        _, grad = attention.loss_and_gradients(plain, x, y, use)
        for n, g in grad.items():
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.98 * second[n] + 0.02 * g**2
            plain[n] = plain[n] - 0.01 * min(1, t / 3) * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.98**t)) + 1e-8)
        adam.step(x, y, use, 0.01)
    assert list(adam.w) == list(plain) and all(np.shares_memory(v, adam.row) for v in adam.w.values())
    for n, v in plain.items():
        assert adam.w[n].shape == v.shape and np.allclose(adam.w[n], v, rtol=1e-6, atol=1e-8)


def test_tiny_shares_still_pick_rows(spark):
    df = spark.range(200_000)
    assert 0 < df.where(common.hashed_share(1e-4, "id")).count() < 100
    hashes = df.select(F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1)).alias("h")).agg(F.min("h")).head()[0]
    assert df.where(common.hashed_share((hashes + 2**20) / 2**63, "id")).count() == 1  # a share of 1 in 200,000 or less


def test_special_strings_are_ids_as_in_the_json_tokenizer(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> <|endof text|>", "plain"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_packing_numbers_equal_rows_alike_on_a_rerun(spark):
    rows = [(1, "same text here")] * 5 + [(1, "another text")] * 3 + [(None, None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted(map(str, packing.pack(df.repartition(n)).collect())) for n in (1, 4)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("ids", [[None] * 2000, [7] * 2000, list(range(1000)) + [None] * 1000])
def test_bytes_stay_near_equal_when_ids_are_null_or_repeat(spark, ids):
    df = spark.createDataFrame([(i, f"text number {k} " * (k % 7)) for k, i in enumerate(ids)], "doc_id long, text string")
    rows = sharding.shard_documents(df, 24).collect()
    assert len(rows) == len(ids)
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 0.1 * sum(load.values()) / 24
    for k in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_letters_are_those_of_category_l():
    assert not any(map(language.has_letter, ["", "12 ½ ² Ⅷ ① _ !", "٣"]))
    assert all(map(language.has_letter, ["a", "½ é", "漢", "Ⅷ ª"]))


def test_long_runs_are_learned_and_scored_whole():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a"])}
    assert list(language.training_words("x" * 70)) == ["x" * 32, "x" * 32, "x" * 6]
    prob = np.full((len(pieces) + 2, 1), 0.1)
    prob[-2] = 0
    table = language.PieceTable(pieces)
    word = "ab" * 2000
    whole = language.forward(language.lattice([word], table), prob)
    old, language.SLAB = language.SLAB, 37
    try:
        assert np.allclose(language.word_likelihoods([word, word], table, prob), whole)
    finally:
        language.SLAB = old
    fitted = language.fit({"漢" * 32: np.array([3.0]), "ab": np.array([5.0])}, 1, pieces)
    assert np.isfinite(fitted).all() and abs(fitted.sum() - 1) < 1e-9


def test_languages_in_blocks_are_fitted_and_scored_as_together(monkeypatch):
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba"])}
    rng = np.random.default_rng(22)
    counts = {"".join(rng.choice(["a", "b"], n)): rng.integers(0, 5, 5).astype(float) for n in (1, 2, 3, 5, 8, 13)}
    whole = language.fit(counts, 5, pieces)
    names = list("vwxyz")
    scores = language.Scorer(names, whole, pieces).likelihoods(["ab ba", "bbbb"])
    monkeypatch.setattr(language, "LANGS", 2)
    assert np.allclose(language.fit(counts, 5, pieces), whole)
    assert np.allclose(language.Scorer(names, whole, pieces).likelihoods(["ab ba", "bbbb"]), scores)


@pytest.mark.parametrize("quality", [0, 1])
def test_labels_of_one_kind_leave_the_verdict_to_the_base_rule(spark, quality):
    rng = np.random.default_rng(23)
    df = spark.createDataFrame([(i, prose(rng, 30)) for i in range(20)] + [(99, "too short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, quality) for i in range(20)], "doc_id long, quality int")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules.rate(df, labels).collect())
    assert quality_rules.kept_documents(df, labels).count() == 20


def test_verdicts_equal_a_plain_walk_down_the_trees(spark):
    rng = np.random.default_rng(24)
    texts = [prose(rng, 40) if i % 2 else " ".join(["buy", "###", "now!!!"] * 4 + [prose(rng, 8)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    trees = quality_rules.fit(df, labels)
    for r in quality_rules.rate(df, labels).collect():
        x = textstats.features(np.array([textstats.describe(texts[r["doc_id"]])]))[0]
        margin = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(feature):
                at = 2 * at + (1 if x[feature[at]] <= threshold[at] else 2)
            margin += value[at - len(feature)]
        assert abs(r["score"] - 1 / (1 + math.exp(-margin))) < 1e-9 and r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.KEEP)


def test_a_repeated_label_id_does_not_flood_the_model(spark):
    rng = np.random.default_rng(25)
    df = spark.createDataFrame([(1, prose(rng, 20)) for _ in range(300)] + [(2, prose(rng, 30))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    trees = quality_rules.fit(df, labels, most=10)
    assert trees.feature.shape[0] > 0


def test_windows_are_retrieved_as_signatures_joined_band_by_band(spark):
    rng = np.random.default_rng(26)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    names, texts = [], []
    for _, t in licenses.TEMPLATES:
        words = licenses.template_words(t)
        for loss in (0, 0.03, 0.3):
            kept = [w if rng.random() >= loss else "lost" for w in words]
            texts.append(f"{filler(int(rng.integers(0, 40)))} {' '.join(kept)} {filler(int(rng.integers(0, 40)))}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, classes = licenses._template_table(df, licenses.TEMPLATES)
    got = {(r["doc_id"], r["template"], r["win"]) for r in licenses.candidates(df, known, sorted({w for w, _ in classes}), ("doc_id",)).select("doc_id", "template", "win").collect()}
    # signatures of all windows of all texts, band by band, then an equi-join in plain Python
    rows = []
    for i, text in enumerate(texts):
        words = licenses.template_words(text)
        for width, span in classes:
            for win in range(-(-len(words) // span)):
                part = words[win * span : win * span + 2 * span + width - 1]
                own = [" ".join(part[k : k + width]) for k in range(len(part) - width + 1)]
                if own:
                    rows.append((i, -1, win, width, span, own))
    rows += [(-1, r["template"], -1, r["width"], r["span"], r["shingles"]) for r in known.collect()]
    signed = spark.createDataFrame(rows, "doc_id long, template int, win int, width int, span int, own array<string>")
    least = ", ".join(f"array_min(transform(own, s -> xxhash64(xxhash64(s), {b})))" for b in range(licenses.BANDS))
    signed = signed.selectExpr("doc_id", "template", "win", "width", "span", f"array({least}) AS bands").collect()
    keys = collections.defaultdict(set)
    for r in signed:
        if r["win"] < 0:
            for b, key in enumerate(r["bands"]):
                keys[(r["width"], r["span"], b, key)].add(r["template"])
    want = {(r["doc_id"], t, r["win"]) for r in signed if r["win"] >= 0 for b, key in enumerate(r["bands"]) for t in keys.get((r["width"], r["span"], b, key), ())}
    assert got == want
    found = {(r["doc_id"], r["template"]) for r in licenses.scan(df).collect()}
    assert all((3 * t + k, t) in found for t in range(len(licenses.TEMPLATES)) for k in (0,))


def test_links_are_the_same_in_one_pass_or_several(spark):
    rng = np.random.default_rng(27)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(7), base ^ np.uint64(1 << 50)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    root = [sorted(map(tuple, simhash.groups(simhash.links(df, len(fps), size)).collect())) for size in (10**9, 100_000)]
    assert root[0] == root[1] and len(root[0]) == 400  # all but the least of each of the 200 groups


def test_rows_of_one_id_are_mixed_apart(spark):
    rows = [(None, "one two three", "a")] * 300 + [(5, "one two three", "a")] * 300 + [(i, "four five", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mixed_documents(df)
    want = {r["source_size"]: r["target"] for r in mixing.mix(df).collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[1800 if r["source"] == "a" else 200] += len(r["text"].split())
    assert all(abs(got[size] - target) <= 6 for size, target in want.items())


def hard(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("_row", "_doc", "_mix_row", "row", "key", "part", "n", "fp", "score", "held_out", "shard", "bucket", "component_id", "lang_pred", "size", "place", "kept", "y"):
        df = df.withColumn(clash, F.lit(1))
    return df


STAGES = corpus_pipeline.STAGES


@needs_tables
@pytest.mark.parametrize("name,stage", STAGES)
def test_stages_take_hard_rows(spark, name, stage):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names, no rows."""
    rng = np.random.default_rng(28)
    good = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(good)] + [(None, None, None, None, None), (50, "", "en", "a", 0), (51, " \n ", None, "b", 3)]
    rows += [(None, prose(rng, 60), None, None, None), (60, " ".join(prose(rng, 1000) for _ in range(100)), "en", "b", 1), (3, good[3], "en", "a", 5), (3, good[3], "en", "a", 5), (61, good[4], None, None, 7)]
    df = hard(spark, rows)
    out = common.store(stage(spark, df, DIR), "hard")
    if name == "packing":
        assert out.agg(F.sum("length")).head()[0] == sum(len(tokens.encoder(tokens.rank_path()).ids(r[1])) + 1 for r in rows)
    else:
        assert out.columns == df.columns
    left = collections.Counter(r["text"] for r in out.select("text").collect()) if name != "packing" else None
    if name in ("language", "quality_rules"):
        assert left[good[0]] == 1 and left[good[3]] == 3 and left[good[4]] == 2 and not left[None] and not left[""]
    if name == "near_duplicates":
        assert all(left[t] == 1 for t in good) and sum(left[t] for t in (None, "", " \n ")) == 1 and len(left) == 15
    nothing = stage(spark, df.where("false"), DIR)
    assert nothing.count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op1_latent_vote", "op5_segmentation_language", "op6_boosted_rules", "op7_virtual_slots", "op9_fair_queue_mix", "op10_simhash_balls"])
def test_queries_return_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES[name](spark, DIR).toPandas().set_index("doc_id")
    assert sorted(rows.index) == sorted(r["doc_id"] for r in docs.collect())
    mod = {"op1_latent_vote": (5, 0), "op5_segmentation_language": (3, 1)}.get(name)
    if mod:
        assert all(bool(h) == (zlib.crc32(str(i).encode()) % mod[0] == mod[1]) for i, h in rows["held_out"].items())
    if name == "op1_latent_vote":
        labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas().set_index("doc_id").join(rows, how="inner")
        held = labels[labels["held_out"]]
        assert (held["predicted"] == held["quality"]).mean() >= 0.9
    if name == "op5_segmentation_language":
        known = docs.where("lang IS NOT NULL").toPandas().set_index("doc_id").join(rows, how="inner")
        held = known[known["held_out"] & (known["lang_pred"] != "und")]
        assert (held["lang"] == held["lang_pred"]).mean() >= 0.95


@needs_tables
def test_search_over_the_whole_table_equals_all_products(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{DIR}/embeddings.parquet").to_pydict()
    v = np.floor(256 * np.array(table["embedding"], np.float32).astype(float)).astype(np.int64)
    ids = np.array(table["vec_id"])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in queries.op3_branch_and_bound(spark, DIR).collect()}
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:5]
        want |= {(int(ids[q]), k + 1): (int(ids[i]), int(s[i])) for k, i in enumerate(order)}
    assert got == want
