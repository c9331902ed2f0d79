import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import backprop, gradients, nn, quantize
from waveloom.operators import codebook as cb
from waveloom.plans.training import FitConfig, adam, fit, fit_autoencoder, fit_gumbel
from waveloom.sources import checkpoints
from waveloom.sources.batches import write_batches


def model(bottleneck, rng, out):
    w = nn.Weights.draw(base=2, dim=4, out=out, seed=3).values
    w = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in w.items()}
    if isinstance(bottleneck, backprop.Residual):
        return w | {f"codebook{i}": rng.normal(size=(k, 4)) for i, k in enumerate(bottleneck.config.num_embeddings, 1)}
    own = {} if bottleneck.config.input_is_logits else {"projection": rng.normal(size=(4, 6)), "bias": rng.normal(size=6)}
    return w | own | {"embedding": rng.normal(size=(bottleneck.config.num_embeddings, out))}


@pytest.mark.parametrize("name", [*nn.Weights.draw(2, 4).values])
def test_kernels_against_differences(name):
    """Encoder and decoder without a bottleneck: every parameter and both directions of every kernel."""
    rng = np.random.default_rng(1)
    w = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in nn.Weights.draw(2, 4, seed=2).values.items()}
    x, weight = rng.normal(size=(2, 32)), rng.normal(size=(2, 32))

    def value(values):
        z, back_z = backprop.encode(x, nn.Weights(values), found := {})
        y, back_y = backprop.decode(z, nn.Weights(values), found)
        return (y * weight).sum(), found, back_y, back_z

    _, found, back_y, back_z = value(w)
    back_z(back_y(weight))
    for at in rng.integers(0, w[name].size, 6):
        sides = []
        for d in (1e-6, -1e-6):
            moved = w[name].copy()
            moved.flat[at] += d
            sides.append(value(w | {name: moved})[0])
        assert abs((sides[0] - sides[1]) / 2e-6 - found[name].flat[at]) < 1e-5 * (1 + abs(found[name].flat[at]))
    assert np.allclose(backprop.encode(x, nn.Weights(w), {})[0], nn.encode(x, nn.Weights(w)))
    z = nn.encode(x, nn.Weights(w))
    assert np.allclose(backprop.decode(z, nn.Weights(w), {})[0], nn.decode(z, nn.Weights(w)))


def test_residual_gradients_go_straight_through():
    """The codebooks' gradients and the decoder's are those of the loss; the encoder's are those of a loss in which
    codewords are held fixed and the decoder's gradient comes to the latent as it is."""
    rng = np.random.default_rng(5)
    b = backprop.Residual(quantize.RVQConfig(2, (5, 3), 4))
    w, x = model(b, rng, 4), rng.normal(size=(3, 32))
    held = backprop.batch_part(x, nn.Weights(w), b, 3)
    z0 = nn.encode(x, nn.Weights(w))
    y0, _, codes, _ = b.forward(z0, nn.Weights(w), {}, 6)
    offset = y0 - z0  # codewords and straight-through shift, fixed

    def surrogate(values):
        v = nn.Weights(values)
        z = nn.encode(x, v)
        loss = ((nn.decode(z + offset, v) - x) ** 2).sum() / x.size
        rest, fixed = z, z0
        for level, name in enumerate(b.names()):
            q = w[name][codes[..., level]]
            learned = values[name][codes[..., level]]
            loss += 0.25 * ((rest - q) ** 2).sum() / z.size + ((learned - fixed) ** 2).sum() / z.size
            rest, fixed = rest - q, fixed - q
        return loss

    for name in w:
        for at in rng.integers(0, w[name].size, 3):
            sides = []
            for d in (1e-6, -1e-6):
                moved = w[name].copy()
                moved.flat[at] += d
                sides.append(surrogate(w | {name: moved}))
            assert abs((sides[0] - sides[1]) / 2e-6 - held[3][name].flat[at]) < 1e-6, name
    halves = [backprop.batch_part(part, nn.Weights(w), b, 3) for part in (x[:1], x[1:])]
    assert all(np.allclose(halves[0][3][k] + halves[1][3][k], held[3][k]) for k in w)
    assert math.isclose(halves[0][0] + halves[1][0], held[0]) and math.isclose(halves[0][1] + halves[1][1], held[1])


@pytest.mark.parametrize("logits", [False, True])
@pytest.mark.parametrize("hard", [False, True])
def test_gumbel_gradients(hard, logits):
    rng = np.random.default_rng(6)
    b = backprop.Gumbel(quantize.GSConfig(4 if logits else 6, 5, 0.7, hard=hard, input_is_logits=logits, kl_weight=0.3))
    w, x = model(b, rng, 5), rng.normal(size=(3, 32))
    noise = rng.gumbel(size=(3, 2, b.config.num_embeddings))
    held = backprop.batch_part(x, nn.Weights(w), b, 3, noise)
    z0 = nn.encode(x, nn.Weights(w))
    y0 = b.forward(z0, nn.Weights(w), {}, 6, noise)[0]

    def loss(values, name):
        v = nn.Weights(values)
        y, rate, _, _ = b.forward(nn.encode(x, v), v, {}, 6, noise)
        if hard and (name.startswith(("down", "latent")) or name in ("projection", "bias")):
            y = y0  # one-hot codes have no gradient
        return ((nn.decode(y, v) - x) ** 2).sum() / x.size + rate

    for name in w:
        for at in rng.integers(0, w[name].size, 3):
            sides = []
            for d in (1e-6, -1e-6):
                moved = w[name].copy()
                moved.flat[at] += d
                sides.append(loss(w | {name: moved}, name))
            assert abs((sides[0] - sides[1]) / 2e-6 - held[3][name].flat[at]) < 1e-6, name


def test_nearest_by_matrix_product():
    rng = np.random.default_rng(7)
    book = rng.integers(-1, 2, (40, 3)).astype(float)
    z = np.concatenate([rng.normal(size=(200, 3)), rng.integers(-1, 2, (200, 3)) / 2])
    assert (backprop.nearest(z, book) == ((z[:, None] - book) ** 2).sum(-1).argmin(1)).all()


def test_erf():
    x = np.concatenate([np.linspace(-7, 7, 4001), [0.0, np.inf, -np.inf, 1e-300]])
    assert np.allclose(nn.erf(x), [math.erf(v) for v in x], rtol=1e-14, atol=1e-16) and np.isnan(nn.erf(np.array([np.nan]))).all()


def test_sums_over_tasks(spark):
    df = spark.range(100).repartition(7)

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            yield {"big": np.full((200, 300), ids.sum(), float), "n": np.array([float(len(ids))])}

    found = gradients.total(df, run, {"big": (200, 300), "n": (1,), "none": (2, 2)})
    assert (found["big"] == 4950).all() and found["n"] == 100 and not found["none"].any()


def tokens(spark, n, dim, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n)], "tok long, z array<double>")


def test_batches_are_files(spark, monkeypatch):
    from waveloom.sources import batches

    monkeypatch.setattr(batches, "FOLDERS", 3)
    placed = spark.range(53).select("id", F.col("id").alias("place"))
    b = write_batches(placed, 53, 7, tasks=2)
    assert (b.total, b.run) == (7, 3)
    assert [sorted(r.id for r in b.read(spark, i).collect()) for i in range(7)] == [list(range(7 * i, 7 * i + 7)) for i in range(7)]
    assert "batch_id" in b.read(spark, 2)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    b.delete(spark)


def numpy_history(z, books, config, orders):
    """Joint fit of residual levels in numpy, batches in the given orders."""
    p = {f"codebook{i}": np.array(b) for i, b in enumerate(books, 1)}
    moments = tuple({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    steps, out = 0, []
    for order in orders:
        losses = []
        for at in range(0, len(z) // config.batch_size * config.batch_size, config.batch_size):
            rest, change, loss = z[order[at : at + config.batch_size]], {}, 0.0
            n = rest.size
            for name, book in p.items():
                found = ((rest[:, None] - book) ** 2).sum(-1).argmin(1)
                error = rest - book[found]
                loss += 1.25 * (error**2).sum() / n
                change[name] = np.zeros_like(book)
                np.add.at(change[name], found, -2 * error / n)
                rest = error
            losses.append(loss)
            steps += 1
            adam(p, moments, change, steps, config.rate)
        out.append(np.mean(losses))
    return out, p


def test_joint_levels_against_numpy(spark):
    t = tokens(spark, 70, 3)
    z = np.array([r.z for r in t.orderBy("tok").collect()])
    books = [cb.from_tokens(t, 0, 6), cb.from_tokens(t, 6, 4, 0.3)]
    config = FitConfig(3, 16, 0.05)
    from waveloom.operators import signals

    orders = [[r.tok for r in signals.shuffle_order(t, "tok", seed=config.seed, epoch=e).orderBy("place").collect()] for e in range(3)]
    want, p = numpy_history(z, [z[:6], z[6:10] * 0.3], config, orders)
    done = fit(t, books, 3, config)
    assert np.allclose([h[1] for h in done.history], want) and done.best_epoch == int(np.argmin(want))
    assert len(done.codebooks) == 2 and want[-1] < want[0]
    if done.best_epoch == 2:
        assert all(np.allclose(done.parameters[k], p[k]) for k in p)
    frame = done.history_frame()
    assert frame.columns[:3] == ["epoch", "loss", "val_loss"] and frame.count() == 3


def test_a_stopped_fit_goes_on(spark, tmp_path):
    t = tokens(spark, 60, 3)
    start, config = [cb.from_tokens(t, 0, 4), cb.from_tokens(t, 4, 4, 0.5)], FitConfig(4, 20, 0.1, decay=True, annealing=(1.0, 0.1, 3, "exp"))
    whole = fit(t, start, 3, config, t)

    class Lost(Exception):
        pass

    def lose(epoch, row):
        if epoch == 1:
            raise Lost

    path = f"file://{tmp_path}/fit"
    with pytest.raises(Lost):
        fit(t, start, 3, config, t, lose, checkpoint=path)
    checkpoints_seen = checkpoints.epochs(spark, path)
    assert checkpoints_seen[-1] == 1
    (tmp_path / "fit" / "attempt-dead").mkdir()
    (tmp_path / "fit" / "epoch-00000009").mkdir()  # not whole: never read
    again = fit(t, start, 3, config, t, checkpoint=path)
    assert np.allclose(np.array(again.history, float), np.array(whole.history, float)) and again.best_epoch == whole.best_epoch
    assert all(np.allclose(again.parameters[k], whole.parameters[k]) for k in whole.parameters)
    assert set(checkpoints.epochs(spark, path)) == {again.best_epoch, 3}
    finished = fit(t, start, 3, config, t, checkpoint=path)
    assert np.allclose(np.array(finished.history, float), np.array(whole.history, float))


def test_gumbel_columns_against_kernels(spark):
    t = tokens(spark, 50, 4, 8)
    rng = np.random.default_rng(9)
    w = {"projection": rng.normal(size=(5, 4)), "bias": rng.normal(size=(5, 1)), "embedding": rng.normal(size=(5, 4))}
    table = lambda a: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "code int, vec array<double>")
    from waveloom.plans.training import gumbel_soft

    z = np.array([r.z for r in t.orderBy("tok").collect()])
    for hard in (False, True):
        config = quantize.GSConfig(5, 4, 0.6, hard=hard, kl_weight=0.4)
        got = {(r.name, r.code, r.dim): r.grad for r in quantize.gumbel_gradients(gumbel_soft(t, {k: table(v) for k, v in w.items()}, config, 0.6), config, 0.6).collect()}
        values = {"projection": w["projection"].T, "bias": w["bias"][:, 0], "embedding": w["embedding"]}
        y, _, _, back = backprop.Gumbel(config).forward(z, nn.Weights(values), found := {}, 50)
        back(2 * (y - z) / z.size)
        assert all(math.isclose(got["embedding", k, d], found["embedding"][k, d], rel_tol=1e-8, abs_tol=1e-12) for k in range(5) for d in range(4))
        assert all(math.isclose(got["projection", k, d], found["projection"][d, k], rel_tol=1e-8, abs_tol=1e-12) for k in range(5) for d in range(4))
        assert all(math.isclose(got["bias", k, 0], found["bias"][k], rel_tol=1e-8, abs_tol=1e-12) for k in range(5))


def test_gumbel_fit_learns(spark):
    t = tokens(spark, 64, 3)
    rng = np.random.default_rng(4)
    table = lambda a: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "code int, vec array<double>")
    start = {"projection": table(rng.normal(size=(6, 3))), "bias": table(np.zeros((6, 1))), "embedding": table(rng.normal(size=(6, 3)))}
    config = quantize.GSConfig(6, 3, 0.5, hard=False, kl_weight=0.01)
    done = fit_gumbel(t, start, config, FitConfig(4, 32, 0.1, annealing=(1.0, 0.5, 3, "cosine")), t)
    assert done.history[-1][2] < done.history[0][2] and set(done.parameters) == {"projection", "bias", "embedding"}
    hard = fit_gumbel(t, start, quantize.GSConfig(6, 3, 0.5, hard=True, kl_weight=0.0), FitConfig(1, 32, 0.1))
    assert np.allclose(hard.parameters["projection"], np.array([r.vec for r in start["projection"].orderBy("code").collect()]))
    with pytest.raises(ValueError):
        fit_gumbel(t, start, quantize.GSConfig(6, 3, input_is_logits=True), FitConfig(1, 32))


@pytest.mark.parametrize("kind", ["residual", "gumbel"])
def test_autoencoder_fit(spark, kind):
    """The fit over many tasks equals the loop in numpy, and its loss falls."""
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(32) * rng.uniform(0.1, 0.6, (24, 1)) + rng.uniform(0, 6, (24, 1)))
    frames = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame int, samples array<double>").repartition(3)
    if kind == "residual":
        b = backprop.Residual(quantize.RVQConfig(2, (8, 4), 4))
        tables = {f"codebook{i}": cb.uniform_init(spark, k, 4, level=i, bound=1.0) for i, k in ((1, 8), (2, 4))}
    else:
        b = backprop.Gumbel(quantize.GSConfig(8, 4, 0.7, hard=False, kl_weight=0.01))
        tables = {"projection": cb.uniform_init(spark, 8, 4, bound=0.5), "bias": cb.uniform_init(spark, 8, 1, level=3, bound=0.1), "embedding": cb.uniform_init(spark, 8, 4, level=2, bound=1.0)}
    w, config = nn.Weights.draw(2, 4), FitConfig(5, 12, 0.02)
    done = fit_autoencoder(frames, ["frame"], w, b, tables, config, frames)
    losses = [h[1] for h in done.history]
    assert done.history[-1][2] < done.history[0][2] and all(h[2] < 10 and h[4] >= 1 and 0 < h[5] <= 1 for h in done.history)
    assert set(done.parameters) == set(w.values) | set(b.names())
    if kind == "residual":
        from waveloom.operators import signals

        p = dict(w.values) | {n: np.array([r.vec for r in tables[n].orderBy("code").collect()]) for n in b.names()}
        moments = tuple({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        steps, want = 0, []
        for e in range(5):
            order = [r.frame for r in signals.shuffle_order(frames, "frame", seed=42, epoch=e).orderBy("place").collect()]
            now = []
            for at in (0, 12):
                recon, layer, _, change = backprop.batch_part(x[order[at : at + 12]], nn.Weights(p), b, 12)
                now.append(recon + layer)
                steps += 1
                adam(p, moments, change, steps, config.rate)
            want.append(np.mean(now))
        assert np.allclose(losses, want)


def test_running_metrics_are_the_batch_s(spark, tmp_path):
    """Three micro-batches, one of them run twice, against the metrics of all rows; and new epochs begin anew."""
    from waveloom.operators import stats
    from waveloom.streaming import metrics as running

    rng = np.random.default_rng(3)
    schema = "epoch long, batch_id long, x array<double>, y array<double>, codes array<int>"
    rows = [(i // 30, i % 30 // 10, rng.normal(size=4).tolist(), rng.normal(size=4).tolist() if i else [0.0] * 4, rng.integers(0, [5, 3]).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    extra = {"first": (F.col("x")[0], F.lit(1.0))}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.accumulate(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), extra).awaitTermination(90)
    tables = sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("micro="))
    assert tables == ["micro=0", "micro=1", "micro=2"]
    got = {(r.epoch, r.metric, r.level): r.value for r in running.metrics(running.state(spark, str(tmp_path / "state")), [5, 3]).collect()}
    whole = {(r.epoch, r.metric, r.level): r.value for r in running.metrics(running.partial_sums(df, extra), [5, 3]).collect()}
    assert got.keys() == whole.keys() and all(math.isclose(got[k], whole[k]) for k in got) and len(got) == 2 * (3 + 2 * 3)
    for epoch in (0, 1):
        own = rows[30 * epoch : 30 * epoch + 30]
        assert math.isclose(got[epoch, "mse", None], np.mean([(np.array(r[2]) - np.array(r[3])) ** 2 for r in own]))
        for level, size in ((1, 5), (2, 3)):
            codes = df.where(f"epoch = {epoch}").select("batch_id", F.element_at("codes", level).alias("code"))
            want = stats.batch_mean(codes, size).first()
            assert all(math.isclose(got[epoch, n, level], want[n]) for n in ("entropy_bits", "perplexity", "usage"))


def test_jobs_of_a_fit_do_not_grow_with_its_batches(spark):
    """Steps are taken within a stage: sixteen times the batches are as many jobs."""
    t, jobs = tokens(spark, 128, 3), []
    books = [cb.from_tokens(t, 0, 4), cb.from_tokens(t, 4, 4, 0.5)]
    for size in (64, 4):
        spark.sparkContext.setJobGroup(f"fit-{size}", "")
        fit(t, books, 3, FitConfig(2, size, 0.05), t)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{size}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1]


def test_shares_that_are_empty(spark):
    """More tasks than a batch has rows in some of them: each takes part in every step."""
    t = tokens(spark, 21, 3)
    books = [cb.from_tokens(t, 0, 4), cb.from_tokens(t, 4, 3, 0.5)]
    few, many = (fit(t, books, 3, FitConfig(2, 2, 0.05, tasks=n), t) for n in (1, 4))
    assert np.allclose(np.array(few.history, float)[:, :3], np.array(many.history, float)[:, :3])
