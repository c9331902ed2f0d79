import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions.columns import anneal, checked, entropy, softmax
from waveloom.functions.columns import erf as erf_column
from waveloom.operators import codebook as cb
from waveloom.operators import nn, quality, quantize, schedule, signals, stats
from waveloom.operators.ranking import hash_rank
from waveloom.plans.codec import GumbelCodec, RVQCodec, Training, fit_codebook, vq_codec
from waveloom.plans.training import FitConfig, fit
from waveloom.sources import tables
from waveloom.streaming.codec import encode_stream, frame_stream


def toks(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "tok long, z array<double>")


def book(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "code int, vec array<double>")


def test_ties_go_to_the_first_code_and_codewords_are_exact(spark):
    b = book(spark, (9, 9), (1, 0), (5, 5), (-1, 0))
    rows = {r.tok: r for r in quantize.assign(toks(spark, (0, 0), (5, 5)), b, 2).collect()}
    assert (rows[0].code, rows[0].dist) == (1, 1.0) and (rows[1].code, rows[1].dist, rows[1].q) == (2, 0.0, [5.0, 5.0])


@pytest.mark.parametrize("bad", [[1.0], [1.0, None], None])
def test_bad_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(0, bad)], "tok long, z array<double>")
    with pytest.raises(Exception, match="not of 2 numbers"):
        df.select(checked(F.col("z"), 2)).collect()


def test_residual_levels_prefix_and_mixed_sizes(spark):
    books = [book(spark, (0, 0), (4, 0)), book(spark, (0, 0), (0, 1), (1, 0))]
    enc = quantize.rvq_encode(toks(spark, (4, 1), (0.9, 0)), books, 2)
    rows = {r.tok: r for r in enc.collect()}
    assert rows[0].codes == [1, 1] and rows[0].y == [4.0, 1.0] and rows[1].codes == [0, 2]
    back = {r.tok: r.y for r in quantize.rvq_decode(enc.select("tok", "codes"), books, 1).collect()}
    assert back == {0: [4.0, 0.0], 1: [0.0, 0.0]}
    with pytest.raises(ValueError):
        quantize.rvq_decode(enc, books, 0)


def test_losses_are_means_over_all_numbers(spark):
    a = quantize.assign(toks(spark, (1, 1), (3, 0)), book(spark, (0, 0)), 2)
    r = quantize.losses(a, 2, 0.25).first()
    assert (r.codebook, r.commitment, r.total) == (11 / 4, 11 / 16, 11 / 4 * 1.25)


def test_code_statistics(spark):
    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "code int")
    one, each = stats.code_stats(codes(3, 3, 3), 8).first(), stats.code_stats(codes(*range(8)), 8).first()
    assert abs(one.entropy_bits) < 1e-6 and abs(one.perplexity - 1) < 1e-6 and one.usage == 1 / 8
    assert abs(each.entropy_bits - 3) < 1e-6 and abs(each.perplexity - 8) < 1e-5 and each.usage == 1
    p = lambda *v: spark.createDataFrame([([float(x) for x in v],)], "p array<double>")
    assert abs(stats.kl_bits(p(0.25, 0.25, 0.25, 0.25), 4).first().kl_bits) < 1e-6
    assert abs(stats.kl_bits(p(1, 0, 0, 0), 4).first().kl_bits - 2) < 1e-6


def test_softmax_entropy_and_indices(spark):
    r = spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0)), 0.5).alias("p")).select("p", entropy(F.col("p")).alias("h"), quantize.hard_index(F.col("p")).alias("i")).first()
    assert r.p == [0.5, 0.5, 0.0] and abs(r.h - math.log(2)) < 1e-9 and r.i == 0
    scored = spark.createDataFrame([(0, [0.0, 1.0])], "tok long, logits array<double>")
    with pytest.raises(ValueError):
        quantize.posteriors(scored, 0.0, 1)
    assert quantize.posteriors(scored, 0.0).first().p == [0.0, 1.0]


@pytest.mark.parametrize("make", [lambda: quantize.VQConfig(0, 2), lambda: quantize.VQConfig(2, 0), lambda: quantize.VQConfig(2, 2, 0), lambda: quantize.RVQConfig(0, 2, 2), lambda: quantize.RVQConfig(2, (2,), 2), lambda: quantize.RVQConfig(1, 0, 2), lambda: quantize.GSConfig(1, 2), lambda: quantize.GSConfig(2, 0), lambda: anneal(F.lit(0), 0.0, 1.0, 3), lambda: anneal(F.lit(0), 1.0, 1.0, 3, "linear")])
def test_guards(spark, make):
    with pytest.raises(ValueError):
        make()


def test_schedules(spark):
    df = spark.createDataFrame([(0,), (10,), (15,)], "epoch int")
    for mode in ("cosine", "exp"):
        assert [round(r.temperature, 9) for r in schedule.temperatures(df, 1.0, 0.2, 10, mode).orderBy("epoch").collect()] == [1.0, 0.2, 0.2]
        assert {r.temperature for r in schedule.temperatures(df.where("epoch = 0"), 1.0, 0.2, 0, mode).collect()} == {1.0}
    hist = spark.createDataFrame([(1, e, float(v)) for e, v in enumerate([5, 4, 4, 6, 3, 1])], "run int, epoch int, val_loss double")
    assert tuple(schedule.early_stopping(hist, 2).first()) == (1, 1, 4.0, 3)
    assert tuple(schedule.early_stopping(hist, 9).first()) == (1, 5, 1.0, None)
    assert [r.epoch for r in schedule.checkpoints(hist).orderBy("epoch").collect()] == [0, 1, 4, 5]


def test_split_shuffle_batches(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    split = {r["split"]: r["count"] for r in signals.split_sources(df, "k").groupBy("split").count().collect()}
    assert split == {"train": 82, "val": 10, "test": 11}
    one, two = ({r.k: r.place for r in signals.shuffle_order(df.repartition(n), "k", epoch=1).collect()} for n in (1, 7))
    assert one == two and sorted(one.values()) == list(range(103))
    key = F.concat_ws(":", F.lit("42"), F.lit("1"), F.col("k").cast("string"))
    assert one == {r.k: r["rank"] for r in hash_rank(df, key, "k", digits=1).collect()}
    assert one != {r.k: r.place for r in signals.shuffle_order(df, "k", epoch=2).collect()}
    full = signals.batches(signals.shuffle_order(df, "k"), 10)
    assert full.count() == 100 and full.select("batch_id").distinct().count() == 10


def test_crop_and_augmenters(spark):
    df = spark.createDataFrame([(i, [float(x) for x in range(20)]) for i in range(30)], "k int, s array<double>")
    crops = [r.c for r in df.select(signals.crop(F.col("s"), 8, F.col("k")).alias("c")).collect()]
    assert all(len(c) == 8 and c == [c[0] + i for i in range(8)] for c in crops) and len({c[0] for c in crops}) > 5
    middle = df.select(signals.crop(F.col("s"), 8, deterministic=True).alias("c")).first().c
    assert middle[0] == 6.0
    cut = df.select(signals.cut_out(F.col("s"), 5, F.col("k")).alias("c")).first().c
    assert len(cut) == 20 and sum(a != b for a, b in zip(cut, range(20), strict=True)) in (4, 5)


def test_kernels_against_loops():
    rng = np.random.default_rng(0)
    for length, width, stride in ((16, 7, 2), (15, 7, 2), (16, 5, 1), (9, 1, 1)):
        x, k, b = rng.normal(size=(2, length, 3)), rng.normal(size=(width, 3, 4)), rng.normal(size=4)
        left, right = nn.same_padding(length, width, stride)
        p = np.pad(x, ((0, 0), (left, right), (0, 0)))
        want = np.stack([[sum(p[n, o * stride + t] @ k[t] for t in range(width)) + b for o in range(-(-length // stride))] for n in range(2)])
        assert np.allclose(nn.conv(x, k, b, stride), want)
    assert nn.same_padding(16, 7, 2) == (2, 3)
    x, d, p = rng.normal(size=(1, 8, 3)), rng.normal(size=(5, 3)), rng.normal(size=(3, 2))
    pad = np.pad(x, ((0, 0), (2, 2), (0, 0)))
    assert np.allclose(nn.separable_conv(x, d, p), np.stack([(pad[0, o : o + 5] * d).sum(0) for o in range(8)])[None] @ p)
    assert np.allclose(nn.gelu(np.array([0.0, 1.0, -1.0])), [0, 0.8413447460685429, -0.15865525393145707])
    n = nn.channel_norm(rng.normal(size=(2, 4, 8)), np.ones(8), np.zeros(8))
    assert np.allclose(n.mean(-1), 0) and np.allclose(n.var(-1), 1, atol=1e-3)


def test_parameter_count_of_the_full_model():
    w = nn.Weights.draw(base=32, dim=16)
    size = lambda *p: sum(v.size for k, v in w.values.items() if k.startswith(p))
    assert (size("down", "latent"), size("up", "out")) == (146_608, 190_753)


@pytest.fixture(scope="module")
def frame_table(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(6)], "frame int, samples array<double>")


def test_codecs(spark, frame_table, tmp_path):
    w = nn.Weights.draw(4, 8)
    books = [cb.uniform_init(spark, k, 8, level=i, bound=1.0) for i, k in enumerate((16, 4), 1)]
    codec = RVQCodec(quantize.RVQConfig(2, (16, 4), 8), w, books)
    enc = codec.encode(frame_table, ["frame"])
    assert enc.count() == 6 * 4
    out = {r.frame: (r.x, r.y) for r in codec.round_trip(frame_table, ["frame"]).collect()}
    x = np.array([out[i][0] for i in range(6)])
    z = nn.encode(x, w)
    tables_ = [np.array([r.vec for r in b.orderBy("code").collect()]) for b in books]
    rest, y = z.copy(), np.zeros_like(z)
    for t in tables_:
        q = t[((rest[:, :, None] - t) ** 2).sum(-1).argmin(-1)]
        rest, y = rest - q, y + q
    assert np.allclose([out[i][1] for i in range(6)], nn.decode(y, w), atol=1e-9)
    tables.save_parameters(books, codec.config, str(tmp_path / "model"))
    again, config = tables.load_parameters(spark, str(tmp_path / "model"), quantize.RVQConfig)
    assert config == codec.config and [b.count() for b in again] == [16, 4]
    assert vq_codec(quantize.VQConfig(16, 8), w, books[0]).round_trip(frame_table, ["frame"]).count() == 6
    gs = GumbelCodec(quantize.GSConfig(16, 8, 0.5), w, books[0], books[0])
    assert gs.round_trip(frame_table, ["frame"]).count() == 6
    recon = codec.round_trip(frame_table, ["frame"])
    assert {r.metric for r in Training(extra_metrics={"prd": quality.prd_percent}).evaluate(recon).collect()} == {"mse", "cosine", "prd"}


def test_weights_round_trip_and_frames_of_one_length(spark, frame_table, tmp_path):
    w = nn.Weights.draw(2, 4, out=6)
    tables.save_weights(spark, w, str(tmp_path / "model"))
    again = tables.load_weights(spark, str(tmp_path / "model"))
    assert w.values.keys() == again.values.keys() and all((w[k] == again[k]).all() for k in w.values)
    odd = frame_table.unionByName(spark.createDataFrame([(9, [0.0] * 32)], frame_table.schema)).coalesce(1)
    with pytest.raises(Exception, match="one length"):
        nn.latents(odd, nn.Weights.draw(2, 4), ["frame"]).collect()


def test_rate_term(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (0, [0.25] * 4), (1, [0.25] * 4)], "b int, p array<double>")
    got = {r.b: r.total for r in quantize.kl_loss(p, quantize.GSConfig(4, 2, kl_weight=0.5), "b").collect()}
    assert abs(got[0] - 0.5) < 1e-6 and abs(got[1]) < 1e-6
    assert quantize.kl_loss(p, quantize.GSConfig(4, 2, kl_weight=0.0)).first().total == 0


def test_frames_by_spans_are_those_of_whole_sources(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), int(t), float(v)) for s, t, v in zip(rng.integers(0, 3, 400), rng.permutation(400), rng.normal(size=400), strict=True)] + [(None, 1, 2.0), (None, 900, 3.0)]
    df = spark.createDataFrame(rows, "s int, t int, v double")
    whole, cut = (sorted(map(tuple, signals.frames(df, "s", ["t"], "v", 16, span).collect()), key=repr) for span in (None, F.expr("t div 50")))
    assert whole == cut and len(whole) > 20


def test_histories_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(schedule, "STRETCH", 3)
    rng = np.random.default_rng(2)
    losses = {r: rng.integers(0, 30, 25) - np.arange(25) // 2 for r in range(4)}
    df = spark.createDataFrame([(r, e, float(v)) for r, x in losses.items() for e, v in enumerate(x)], "run int, epoch int, val_loss double")
    stops = {r.run: r for r in schedule.early_stopping(df, 4).collect()}
    points = sorted((r.run, r.epoch) for r in schedule.checkpoints(df).collect())
    want = []
    for r, x in losses.items():
        best = at = None
        stop = None
        for e, v in enumerate(x):
            if best is None or v < best:
                best, at = v, e
                want.append((r, e))
            if e - at >= 4 and stop is None:
                stop = e
        assert stops[r].stop_epoch == stop
    assert points == want


def test_fit_in_batches(spark):
    rng = np.random.default_rng(5)
    t = toks(spark, *rng.normal(size=(50, 2)))
    start = cb.from_tokens(t, 0, 4)
    seen = []
    done = fit(t, start, 2, FitConfig(3, 16, 0.2, annealing=(1.0, 0.1, 2, "cosine")), t, lambda e, row: seen.append(row))
    assert [r["epoch"] for r in seen] == [0, 1, 2] and [round(r["temperature"], 6) for r in seen] == [1.0, 0.55, 0.1]
    loss = lambda b: quantize.losses(quantize.assign(t, b, 2), 2, 0.25).first().total
    assert abs(loss(done.codebook) - min(h[2] for h in done.history)) < 1e-9 < loss(start) - loss(done.codebook)
    stopped = fit(t, start, 2, FitConfig(5, 50, 1e-12, patience=1), t)
    assert len(stopped.history) < 5 or stopped.best_epoch == 4
    with pytest.raises(ValueError):
        fit(t, start, 2, FitConfig(1, 51))


def test_codebook_learns(spark):
    rng = np.random.default_rng(5)
    t = toks(spark, *rng.normal(size=(60, 2)))
    start = cb.from_tokens(t, 0, 4)
    loss = lambda b: quantize.losses(quantize.assign(t, b, 2), 2, 0.25).first().codebook
    seen = []
    fitted = fit_codebook(t, start, 2, 2.0, 3, lambda i, b: seen.append(i))
    assert seen == [0, 1, 2] and loss(fitted) < loss(start)
    assert cb.kmeans_init(t, 4).count() == 4
    with pytest.raises(Exception, match="too large"):
        cb.as_row(spark.range(5).selectExpr("cast(id as int) code", "array_repeat(0D, 1000000) vec")).collect()


def test_streams(spark, tmp_path):
    t = toks(spark, (0, 0), (4, 1))
    t.write.parquet(str(tmp_path / "tokens"))
    books = [book(spark, (0, 0), (4, 0))]
    stream = encode_stream(spark.readStream.schema(t.schema).parquet(str(tmp_path / "tokens")), books, 2)
    stream.writeStream.format("memory").queryName("codes").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.tok, r.codes) for r in spark.table("codes").collect()) == [(0, [0]), (1, [1])]
    pytest.importorskip("google.protobuf")
    s = spark.createDataFrame([("a", i, float(i)) for i in range(7)] + [("b", 0, 1.0)], "source string, at long, x double")
    s.write.parquet(str(tmp_path / "samples"))
    framed = frame_stream(spark.readStream.schema(s.schema).parquet(str(tmp_path / "samples")), 3)
    framed.writeStream.format("memory").queryName("framed").outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    assert sorted(map(tuple, spark.table("framed").collect())) == [("a", 0, [0.0, 1.0, 2.0]), ("a", 1, [3.0, 4.0, 5.0])]


def test_sources(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 2.0])], "lead int, samples array<float>").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = tables.signals(spark, str(tmp_path / "p")).collect()
    assert len(rows) == 1 and rows[0].patient_id.startswith("part-") and rows[0].samples == [1.0, 2.0]
    tables.write_history(spark.createDataFrame([(0, 1.5, 2.5)], "epoch int, loss double, val_loss double"), str(tmp_path / "h"))
    assert tuple(tables.read_history(spark, str(tmp_path / "h")).first()) == (0, 1.5, 2.5)


def test_drawn_augmenters(spark):
    n = 400
    df = spark.createDataFrame([(i, [2 + float(np.sin(x / 9 + i)) for x in range(n)]) for i in range(30)], "k int, s array<double>")
    held = lambda c: np.array([r.x for r in df.select("k", c.alias("x")).orderBy("k").collect()])
    x = held(F.col("s"))
    noise = held(signals.add_gaussian_noise(F.col("s"), (0.5, 2.0), F.col("k"))) - x
    spread = noise.std(1)
    assert abs(noise.mean()) < 0.05 and spread.min() > 0.4 and spread.max() < 2.2 and np.ptp(spread) > 0.5
    unit = (noise / spread[:, None]).ravel()
    assert abs((unit**3).mean()) < 0.1 and abs((unit**4).mean() - 3) < 0.2
    factors = held(signals.warp_amplitude(F.col("s"), (0.9, 1.1), (0.5, 1.5), 100.0, F.col("k"))) / x
    assert factors.min() > 0.89 and factors.max() < 1.11 and np.abs(np.diff(factors[:, 100:200])).max() < 0.005 and np.ptp(factors) > 0.1
    bends = (np.abs(np.diff(factors, 2)) > 1e-9).sum(1)  # straight between some control points
    assert bends.max() <= 12 and bends.min() >= 1
    wander = held(signals.add_wander(F.col("s"), (0.0, 1.0), (0.5, 1.5), 100.0, F.col("k"))) - x
    assert np.abs(wander).max() <= 1 and np.ptp(np.abs(wander).max(1)) > 0.3
    hum = held(signals.add_random_sine(F.col("s"), (0.0, 0.05), (45.0, 50.0), 500.0, F.col("k"))) - x
    peaks = np.abs(np.fft.rfft(hum))[:, 1:].argmax(1) + 1
    assert np.abs(hum).max() <= 0.05 and set(peaks * 500 / n) <= {x * 1.25 for x in range(35, 42)}


def test_background_noise(spark):
    df = spark.createDataFrame([(i, [float(i)] * 10) for i in range(50)], "k int, samples array<double>")
    noises = spark.createDataFrame([(0, [100.0] * 7), (1, [200.0, 300.0] * 20), (2, [])], "place long, samples array<double>")
    rows = {r.k: np.array(r.samples) - r.k for r in signals.add_background(df, noises, (0.1, 0.2), 1, "k").collect()}
    assert len(rows) == 50 and all(len(v) == 10 for v in rows.values())
    kinds = {0: 0, 1: 0, 2: 0}
    for v in rows.values():
        levels = sorted(set(np.round(v, 9)))
        if not v.any():
            kinds[2] += 1
        elif len(levels) == 1:
            kinds[0] += 1
            assert 10 <= levels[0] <= 20
        else:
            kinds[1] += 1
            assert abs(levels[1] / levels[0] - 1.5) < 1e-6 and (np.diff(v) != 0).all()
    assert all(kinds.values())
    assert sorted(signals.add_background(df, noises.where("false"), (0.1, 0.2), 2, "k").select("k", "samples").collect()) == sorted(df.collect())


def test_column_blocks_against_kernels(spark):
    rng, w = np.random.default_rng(8), nn.Weights.draw(2, 4)
    w = nn.Weights({k: v + rng.normal(size=v.shape) * 0.2 for k, v in w.values.items()})
    for name, column, kernel, channels in (("down1", nn.down_block_column, nn.down_block, 1), ("down2", nn.down_block_column, nn.down_block, 2), ("up4", nn.up_block_column, nn.up_block, 4)):
        x = rng.normal(size=(3, 9, channels))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<array<double>>")
        got = np.array([r.y for r in df.select("i", column(F.col("x"), w, name, 9).alias("y")).orderBy("i").collect()])
        assert np.allclose(got, kernel(x, w, name), atol=1e-12)
    values = [-8.0, -6.0, -3.3, -1e-9, 0.0, 0.4, 2.9, 5.99, 7.0]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(erf_column(F.col("v")).alias("y")).collect()]
    assert np.allclose(got, [math.erf(v) for v in values], rtol=1e-13, atol=1e-18)


def test_totals_of_a_shuffled_order(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    full = signals.batches(signals.shuffle_order(df, "k", total="n"), 10, total="n")
    assert full.columns == ["k", "place", "batch_id"] and full.count() == 100
    assert signals.batches(signals.shuffle_order(df.where("false"), "k", total="n"), 10, total="n").count() == 0
