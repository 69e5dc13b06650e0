"""No cuts, caps or crashes: runs with a halo, large batches, degenerate metric
groups, lookups that must hit, half-written caches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinemetric.operators import captions as C
from cinemetric.operators import contrastive as L
from cinemetric.operators import coverage as V
from cinemetric.operators import metrics as M
from cinemetric.operators import tables as T
from cinemetric.operators import vectors as VE
from cinemetric.sources import sinks


def test_labels_with_halo_equal_whole_video(spark):
    rows = [("v", c, w, f"x{(c * 7 + w) % 5}", "t") for c in range(30) for w in range(3)]
    words = spark.createDataFrame(rows, "video_id string, cap_idx int, w_idx int, word string, time_range string")

    def model(ws):          # a label depends on the two words before and the one after
        return [(w, "." if (ws[max(0, i - 2)] + ws[min(len(ws) - 1, i + 1)]) in ("x0x1", "x3x2", "x1x0") else "0", 0.5) for i, w in enumerate(ws)]

    key = ["video_id", "cap_idx", "w_idx"]
    whole = C.label_words_by_video(words, model, captions_per_call=None).orderBy(*key).collect()
    cut = C.label_words_by_video(words, model, captions_per_call=4, halo=2).orderBy(*key).collect()
    assert whole == cut


def test_large_batch(spark):
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("b"), "id", F.array(F.sin("id"), F.cos("id")).alias("x"), F.array(F.cos("id"), F.sin("id")).alias("y"))
    got = L.contrastive_loss(df, "b", "x", "y").first()
    i = np.arange(n)
    logits = np.stack([np.sin(i), np.cos(i)], 1) @ np.stack([np.cos(i), np.sin(i)], 0)
    lse = lambda a, k: np.log(np.exp(a).sum(k))
    want = ((lse(logits, 1) - np.diag(logits)).mean() + (lse(logits, 0) - np.diag(logits)).mean()) / 2
    assert got.n == n and abs(got.loss - want) < 1e-9
    assert L.dissimilarity(df, "b", "id", "x").count() == 1


def test_weights_without_underflow():
    assert np.isfinite(L.sentiment_weights(np.array([[0.0, 2000.0], [5.0, 1.0], [1.0, 7.0]]))).all()


def test_degenerate_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 4.0)], "g string, p double, y double")
    got = {r.g: r.r2 for r in M.regression_metrics(df, "p", "y", ["g"]).collect()}
    assert got["a"] is None and got["b"] is not None
    lab = spark.createDataFrame([("a", 0, 0.2), ("a", 0, 0.4), ("b", 1, 0.9), ("b", 0, 0.1)], "c string, l int, s double")
    assert {r.c: r.ap for r in M.average_precision(lab, "c", "l", "s").collect()} == {"a": 0.0, "b": 1.0}
    assert all(r.density is None for r in M.density(df.where("g = 'a'"), "y").collect())


def test_lookups_must_hit(spark):
    clips = spark.createDataFrame([(1, "x"), (2, "y")], "k int, label string")
    scores = spark.createDataFrame([(1, 0.5)], "k int, s double")
    with pytest.raises(Exception, match="missing s"):
        V.attach_scores(clips, scores, ["k"], "s").select("k").collect()
    with pytest.raises(Exception, match="unknown label"):
        T.label_index(clips, "label", spark.createDataFrame([("x", 0)], "name string, class_id int")).select("k").collect()


def test_half_written_cache_is_rebuilt(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    spark.range(5).write.parquet(path)
    import os
    os.rename(f"{path}/_SUCCESS", f"{path}/_gone")
    assert sinks.feature_cache(spark, path, lambda: spark.range(100)).count() == 100
    assert sinks.feature_cache(spark, path, lambda: spark.range(3)).count() == 100


def test_special_tokens_stay_whole(spark):
    from cinemetric.operators import tokenize as TK
    vocab = TK.build_vocab([])
    got = {r["k"]: r["ids"] for r in TK.encode_texts(
        spark.createDataFrame([(1, "a<|endoftext|>b"), (2, None), (3, "")], "k int, t string"), "k", "t", []).collect()}
    assert got == {1: [vocab["a</w>"], vocab["<|endoftext|>"], vocab["b</w>"]], 2: [], 3: []}


def test_scores_are_formatted_like_python(spark):
    from cinemetric.functions import text as T
    values = [1.005, 2.675, 0.125, 0.375, 4.625, 9.995, 3.0, 0.0, -1.005, 123.455]
    got = spark.createDataFrame([(values,)], "v array<double>").select(T.format_scores("v")).first()[0]
    assert got == ";".join(f"{v:.2f}" for v in values)


def test_pair_scores_equal_the_whole_network():
    import numpy as np
    from cinemetric.operators.regressor import Regressor
    rng = np.random.default_rng(1)
    net, left, right = Regressor.init(6, seed=2), rng.normal(size=(5, 4)), rng.normal(size=2)
    ids = np.array([4, 0, 0, 3])
    whole = net.forward(np.hstack([left[ids], np.tile(right, (4, 1))]))
    assert np.allclose(net.forward_pairs(net.hidden_left(left), ids, right, step=3), whole)


def test_one_batch_in_many_tiles(spark):
    rng = np.random.default_rng(3)
    n, x, y, s = 300, rng.normal(0, 1, (300, 5)), rng.normal(0, 1, (300, 5)), rng.normal(0, 2, (300, 4))
    rows = [(None if i % 3 == 0 else i % 2, x[i].tolist(), y[i].tolist(), s[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, x array<double>, y array<double>, s array<double>").repartition(5)
    for tile in (17, 1000):
        got = {r.b: r for r in L.contrastive_loss(df, "b", "x", "y", 3.0, "s", 0.5, tile=tile).collect()}
        assert set(got) == {None, 0, 1}
        for b in got:
            mine = [i for i in range(n) if rows[i][0] == b]
            logits = 3.0 * x[mine] @ y[mine].T
            w = L.sentiment_weights(s[mine])
            assert got[b].n == len(mine)
            assert abs(got[b].loss - L.clip_loss_from_logits(logits)) < 1e-9
            assert abs(got[b].reweighted_loss - L.clip_loss_from_logits(logits - 0.5 * w)) < 1e-9


def test_tiles_merge_infinities(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], [1.0, 0.0]), (1, [0.5, 0.5], [0.0, 1.0]), (1, [0.1, 0.9], [0.3, 0.3])], "b int, x array<double>, s array<double>")
    df = df.unionByName(df.where("s[0] = 1"))          # equal scores: an infinite weight, which takes the pair out
    got = L.contrastive_loss(df, "b", "x", "x", 1.0, "s", 1.0, tile=1).first()
    assert np.isfinite(got.reweighted_loss) and got.n == 4
    assert L.contrastive_loss(df.limit(0), "b", "x", "x").count() == 0


def _brute_top(x, c, ids, k, scale):
    s = scale * x @ c.T
    order = [sorted(range(len(ids)), key=lambda j: (-s[i, j], -j))[:k] for i in range(len(x))]
    m = s.max(axis=1)
    return [([(r + 1, ids[j], s[i, j]) for r, j in enumerate(o)], m[i] + np.log(np.exp(s[i] - m[i]).sum())) for i, o in enumerate(order)]


@pytest.mark.parametrize("max_values", [10**6, 4 * 7, 1])
def test_top_classes_in_blocks(spark, max_values):
    rng = np.random.default_rng(1)
    x, c = np.round(rng.normal(0, 1, (23, 4)), 1), np.round(rng.normal(0, 1, (30, 4)), 1)
    c[11], c[29], c[3] = c[2], c[2], c[2]                          # equal scores
    ids = [f"c{j:02d}" for j in range(30)]
    items = spark.createDataFrame([(i, v.tolist(), "t") for i, v in enumerate(x)], "i int, v array<double>, top_ string").repartition(3)
    classes = spark.createDataFrame([(n, v.tolist()) for n, v in zip(ids, c)], "name string, w array<double>").repartition(4)
    got = VE.top_classes(items, "v", classes, "name", "w", 5, 2.0, max_values).orderBy("i").collect()
    for r, (top, lse) in zip(got, _brute_top(x, c, ids, 5, 2.0)):
        assert [(t.rank, t.class_id) for t in r.top] == [t[:2] for t in top] and abs(r.lse - lse) < 1e-9
        assert np.allclose([t.score for t in r.top], [t[2] for t in top])
    assert VE.top_classes(items, "v", classes.limit(0), "name", "w").where("size(top) = 0 and lse is null").count() == 23
    assert VE.top_classes(items.limit(0), "v", classes, "name", "w").count() == 0
    pairs = VE.top_pairs(VE.top_classes(items, "v", classes, "name", "w", 40, 2.0, max_values), ["i"])
    assert pairs.count() == 23 * 30 and abs(pairs.agg(F.sum("prob")).first()[0] - 23) < 1e-9


def test_top_of_block_takes_the_later_of_equal_classes():
    s = np.zeros((2, 50))
    s[1, [3, 7]] = 1
    assert VE._top_of_block(s, 3).tolist() == [[49, 48, 47], [7, 3, 49]]


def test_template_selection_equals_one_job_per_candidate(spark):
    from cinemetric.plans import zero_shot as Z
    rng = np.random.default_rng(2)
    words = ["red fox", "blue jay", "old oak", "tin can", "sea urchin"]
    classes = spark.createDataFrame([(i, [w, w.split()[1]]) for i, w in enumerate(words)], "c int, names array<string>")
    rows = [(k, " ".join(rng.permutation([*words[k % 5].split(), "photo", "of", "shop", "bad"][: 2 + k % 4]).tolist()), None if k == 7 else k % 5) for k in range(60)]
    items = spark.createDataFrame(rows, "k int, t string, label int").repartition(3)
    templates = ["a photo of a {}.", "a bad photo of the {}.", "{} in a shop", "{}"]
    want, chosen, best, left = [], [], -1.0, list(templates)
    while left:                                                    # every candidate scored by itself
        rates = [(Z.zero_shot_accuracy(items, "k", "t", "label", classes, "c", "names", chosen + [t], ks=(1,)).first()["top1"], -templates.index(t)) for t in left]
        top, no = max(rates)
        if top <= best:
            break
        best, t = top, templates[-no]
        chosen.append(t)
        left.remove(t)
        want.append((len(chosen), t, pytest.approx(top)))
    for values in (10**6, 64 * 4 * 2):
        assert Z.select_templates(items, "k", "t", "label", classes, "c", "names", templates, max_values=values) == want
    assert Z.select_templates(items, "k", "t", "label", classes, "c", "names", templates, max_templates=1) == want[:1]
