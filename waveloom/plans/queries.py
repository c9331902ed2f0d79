"""Queries over the test tables, one or more per operator: embeddings are latents (four tokens of 16 numbers
each), events are signals (a user is a patient), and histories and frames are made from them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.functions import columns
from waveloom.functions.columns import dot, entropy, hash_uniform, squared_distance
from waveloom.operators import backprop, nn, quality, quantize, schedule, signals, stats
from waveloom.operators import codebook as cb
from waveloom.plans import training
from waveloom.plans.codec import GumbelCodec, RVQCodec, Training, level_metrics
from waveloom.sources import shared
from waveloom.sources.tables import load
from waveloom.streaming import metrics as running

DIM, K, BATCH, FRAME, SEED = 16, 16, 256, 16, 42
TAPS = [0.05, -0.1, 0.2, 0.5, 0.25, -0.15, 0.1]
DEEP = [0.1, 0.2, 0.4, 0.2, 0.1]
POINT = [0.5, -1.5, 2.0]


def r6(c):
    return F.round(c, 6)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(tok, z): each embedding is four tokens."""
    df = load(spark, d, "embeddings").select("vec_id", F.posexplode(F.array(*[F.slice("embedding", 1 + DIM * i, DIM) for i in range(4)])).alias("pos", "part"))
    return df.select((F.col("vec_id") * 4 + F.col("pos")).alias("tok"), F.col("part").cast("array<double>").alias("z"))


def books(t: DataFrame, sizes=(K, K)) -> list[DataFrame]:
    out, first = [], 0
    for level, k in enumerate(sizes):
        out.append(cb.from_tokens(t, first, k, 0.25**level))
        first += k
    return out


def assigned(spark, d):
    t = tokens(spark, d)
    return quantize.assign(t, books(t)[0], DIM)


def encoded(spark, d, sizes=(K, K)):
    t = tokens(spark, d)
    return quantize.rvq_encode(t, books(t, sizes), DIM)


def in_batches(df: DataFrame) -> DataFrame:
    return signals.batches(df, BATCH, "tok")


def event_frames(spark, d):
    return signals.frames(load(spark, d, "events"), "user_id", ["ts", "event_id"], "value", FRAME, F.to_date("ts"))


def full_frames(spark, d):
    return event_frames(spark, d).where(F.size("samples") == FRAME)


def cells(df: DataFrame, array: str, *keys: str, name: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("dim", name)).withColumn(name, r6(name))


# ------------------------------------------------------------------ signals


def signal_split(spark, d):
    return signals.split_sources(load(spark, d, "events"), "user_id", SEED)


def signal_shuffle_order(spark, d):
    return signals.shuffle_order(load(spark, d, "events").select("event_id"), "event_id", seed=SEED, epoch=1)


def signal_frames(spark, d):
    f = event_frames(spark, d)
    return f.select("user_id", "frame", F.size("samples").alias("n"), r6(F.element_at("samples", 1)).alias("first_value"), r6(F.element_at("samples", -1)).alias("last_value"))


def signal_union(spark, d):
    e = load(spark, d, "events").select("user_id", "value")
    return e.where("user_id % 2 = 0").unionByName(e.where("user_id % 2 <> 0")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def frame_batch_drop_remainder(spark, d):
    placed = signals.shuffle_order(full_frames(spark, d).select("user_id", "frame"), "user_id", "frame", seed=SEED, epoch=0, total="rows")
    return signals.batches(placed, 32, total="rows").select("user_id", "frame", "place", "batch_id")


def frame_layernorm(spark, d):
    f = event_frames(spark, d)
    return cells(f.withColumn("x", signals.normalise(F.col("samples"))), "x", "user_id", "frame")


def frame_crop(spark, d):
    f = full_frames(spark, d)
    return cells(f.withColumn("x", signals.crop(F.col("samples"), 8, F.col("user_id"), F.col("frame"), seed=SEED)), "x", "user_id", "frame")


def frame_pairs(spark, d):
    p = signals.pairs(full_frames(spark, d))
    return p.select("user_id", "frame", F.posexplode(F.arrays_zip("x", "y")).alias("dim", "h")).select("user_id", "frame", "dim", r6("h.x").alias("x"), r6("h.y").alias("y"))


def frame_time_axis(spark, d):
    return signals.time_axis(full_frames(spark, d)).select("user_id", "frame", "pos", r6("seconds").alias("seconds"), r6("x").alias("x"))


def frame_noise(spark, d):
    f = full_frames(spark, d)
    return cells(f.withColumn("x", signals.add_noise(F.col("samples"), 0.5, F.col("user_id"), F.col("frame"), seed=SEED)), "x", "user_id", "frame")


def frame_sine(spark, d):
    return cells(full_frames(spark, d).withColumn("x", signals.add_sine(F.col("samples"), 0.3, 50.0)), "x", "user_id", "frame")


def frame_amplitude(spark, d):
    f = full_frames(spark, d)
    return cells(f.withColumn("x", signals.scale_amplitude(F.col("samples"), 0.1, F.col("user_id"), F.col("frame"), seed=SEED)), "x", "user_id", "frame")


def frame_cutout(spark, d):
    f = full_frames(spark, d)
    return cells(f.withColumn("x", signals.cut_out(F.col("samples"), 4, F.col("user_id"), F.col("frame"), seed=SEED)), "x", "user_id", "frame")


def _augmented(spark, d, augment):
    f = full_frames(spark, d)
    return cells(f.withColumn("x", augment(F.col("samples"), F.col("user_id"), F.col("frame"))), "x", "user_id", "frame")


#: Samples a second of the short test frames, so that a frame is longer than a control point's distance.
SLOW = 10.0


def frame_amplitude_warp(spark, d):
    return _augmented(spark, d, lambda x, *key: signals.warp_amplitude(x, (0.9, 1.1), (0.5, 1.5), SLOW, *key, seed=SEED))


def frame_wander(spark, d):
    return _augmented(spark, d, lambda x, *key: signals.add_wander(x, (0.0, 1.0), (0.5, 1.5), SLOW, *key, seed=SEED))


def frame_powerline(spark, d):
    return _augmented(spark, d, lambda x, *key: signals.add_random_sine(x, (0.0, 0.05), (45.0, 50.0), 500.0, *key, seed=SEED))


def frame_gaussian_noise(spark, d):
    return _augmented(spark, d, lambda x, *key: signals.add_gaussian_noise(x, (0.1, 0.5), *key, seed=SEED))


def frame_background(spark, d):
    """Noises are the frames of another cut of the same series, in a shuffled order."""
    noises = signals.frames(load(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 24, F.to_date("ts"))
    noises = signals.shuffle_order(noises, "user_id", "frame", seed=SEED, epoch=3)
    return cells(signals.add_background(full_frames(spark, d), noises, (0.05, 0.2), 2, "user_id", "frame", seed=SEED), "samples", "user_id", "frame")


# ------------------------------------------------------------------ one level


def codebook_uniform_init(spark, d):
    """A codeword for every vector of the table."""
    codes = load(spark, d, "embeddings").select(F.col("vec_id").alias("code"))
    return cells(cb.uniform_rows(codes, DIM, 1.0 / K, SEED), "vec", "code")


def vq_distance(spark, d):
    t = tokens(spark, d)
    return quantize.distances(t, books(t)[0]).select("tok", "code", r6("dist").alias("dist"))


def vq_assign(spark, d):
    return assigned(spark, d).select("tok", "code", r6("dist").alias("dist"))


def vq_dequantize(spark, d):
    t = tokens(spark, d)
    return cells(quantize.dequantize(assigned(spark, d).select("tok", "code"), books(t)[0]), "q", "tok")


def vq_loss(spark, d):
    return quantize.losses(assigned(spark, d), DIM, 0.25).select(*[r6(c).alias(c) for c in ("commitment", "codebook", "total")])


STATS = ("entropy_bits", "perplexity", "usage")


def vq_histogram(spark, d):
    return stats.histogram(in_batches(assigned(spark, d)), "batch_id")


def vq_stats_batch_mean(spark, d):
    return stats.batch_mean(in_batches(assigned(spark, d)), K).select(*[r6(c).alias(c) for c in STATS])


def vq_stats_global(spark, d):
    return stats.code_stats(assigned(spark, d), K).select(*[r6(c).alias(c) for c in STATS])


# ------------------------------------------------------------------ residual levels


def _codes(df):
    return df.select("tok", *[x.alias(n) for i in (1, 2) for n, x in ((f"c{i}", F.col("codes")[i - 1]), (f"d{i}", r6(F.col("dists")[i - 1])))])


def rvq_encode(spark, d):
    return _codes(encoded(spark, d))


def rvq_mixed_k(spark, d):
    return _codes(encoded(spark, d, (K, 8)))


def rvq_decode(spark, d, levels=2):
    t = tokens(spark, d)
    return cells(quantize.rvq_decode(encoded(spark, d).select("tok", "codes"), books(t), levels), "y", "tok")


def rvq_level_loss(spark, d):
    rows = quantize.level_rows(encoded(spark, d))
    mse = F.sum("dist") / (F.count(F.lit(1)) * DIM)
    return rows.groupBy("level").agg(r6(mse * 0.25).alias("commitment"), r6(mse).alias("codebook"), r6(mse * 1.25).alias("total"))


def _metrics(spark, d, sizes):
    return level_metrics(in_batches(encoded(spark, d, sizes)), quantize.RVQConfig(2, sizes, DIM))


def rvq_level_stats(spark, d):
    return _metrics(spark, d, (K, 8))[0].select("level", *[r6(c).alias(c) for c in STATS])


def rvq_summary_stats(spark, d):
    return _metrics(spark, d, (K, 8))[1].select(*[r6(c).alias(c) for c in STATS])


# ------------------------------------------------------------------ Gumbel softmax

GK, TAU = 8, 0.1


def gs_tables(spark):
    projection = cb.uniform_init(spark, GK, DIM, SEED, level=11, bound=(1.0 / DIM) ** 0.5)
    return projection, cb.uniform_init(spark, GK, DIM, SEED, level=12)


def gs_bias(k):
    return hash_uniform(SEED, 13, k) * 0.1


def gs_weights(spark, d):
    """Projection and embedding with a code for every vector of the table."""
    codes = load(spark, d, "embeddings").select(F.col("vec_id").alias("code"))
    p, e = cb.uniform_rows(codes, DIM, (1.0 / DIM) ** 0.5, SEED, 11), cb.uniform_rows(codes, DIM, 1.0 / GK, SEED, 12)
    both = p.select(F.lit("projection").alias("name"), "code", "vec").unionByName(e.select(F.lit("embedding").alias("name"), "code", "vec"))
    return cells(both, "vec", "name", "code")


def scored(spark, d):
    return quantize.logits(tokens(spark, d), gs_tables(spark)[0], gs_bias)


def soft(spark, d, noise=None):
    return quantize.posteriors(scored(spark, d), TAU, noise)


def gs_logits(spark, d):
    return cells(scored(spark, d), "logits", "tok")


def gs_logits_passthrough(spark, d):
    direct = tokens(spark, d).withColumn("logits", F.slice("z", 1, GK))
    return cells(quantize.posteriors(direct, 0.5), "p", "tok")


def gs_softmax(spark, d):
    return cells(soft(spark, d), "p", "tok")


def gs_gumbel_softmax(spark, d):
    return cells(soft(spark, d, 7), "p", "tok")


def gs_gumbel_noise(spark, d):
    noise = F.transform(F.sequence(F.lit(0), F.lit(GK - 1)), lambda k: quantize.gumbel(hash_uniform(7, F.col("tok"), k)))
    return cells(tokens(spark, d).withColumn("g", noise), "g", "tok")


def gs_index(spark, d):
    return soft(spark, d).select("tok", quantize.hard_index(F.col("p")).alias("code"))


def _embedded(spark, d):
    return cb.attach(soft(spark, d), e=gs_tables(spark)[1])


def gs_expected_embedding(spark, d):
    return cells(_embedded(spark, d).withColumn("y", quantize.expected_embedding(F.col("p"), F.col("e"), DIM)), "y", "tok")


def gs_hard_embedding(spark, d):
    return cells(_embedded(spark, d).withColumn("y", quantize.hard_embedding(F.col("p"), F.col("e"))), "y", "tok")


def gs_token_entropy(spark, d):
    return soft(spark, d).select("tok", r6(entropy(F.col("p"))).alias("nats"))


def gs_kl_bits(spark, d):
    return stats.kl_bits(in_batches(soft(spark, d)), GK, "batch_id").select("batch_id", r6("kl_bits").alias("kl_bits"))


def gs_kl_loss(spark, d):
    config = quantize.GSConfig(GK, DIM, kl_weight=0.25)
    return quantize.kl_loss(in_batches(soft(spark, d)), config, "batch_id").select("batch_id", r6("total").alias("kl_loss"))


def gs_stats(spark, d):
    rows = in_batches(soft(spark, d)).withColumn("code", quantize.hard_index(F.col("p")))
    bits = stats.kl_bits(rows, GK, "batch_id").agg(F.avg("kl_bits").alias("bits"))
    return stats.batch_mean(rows, GK).join(F.broadcast(bits)).select(r6("bits").alias("bits"), r6("perplexity").alias("perplexity"), r6("usage").alias("usage"), F.lit(TAU).alias("temperature"))


# ------------------------------------------------------------------ quality


def recon(spark, d):
    return encoded(spark, d).select("tok", F.col("z").alias("x"), "y")


def _recon(metric, spark, d):
    return recon(spark, d).agg(r6(metric()).alias("value"))


def recon_weighted_mse(spark, d):
    return recon(spark, d).agg(r6(quality.weighted_mse((F.col("tok") % 5 + 1).cast("double"))).alias("value"))


def total_loss(spark, d):
    """Reconstruction, extra and layer losses of one model: those of the levels that made the reconstruction."""
    layers = [quantize.layer_loss(F.element_at("dists", level), DIM, 0.25) for level in (1, 2)]
    out = Training([quality.derivative_loss]).loss(encoded(spark, d).withColumnRenamed("z", "x"), *layers)
    return out.select(*[r6(c).alias(c) for c in ("recon", "extra", "layer", "loss")])


def train_metrics(spark, d):
    return Training(extra_metrics={"prd": quality.prd_percent}).evaluate(recon(spark, d)).select("metric", r6("value").alias("value"))


def stream_metrics(spark, d):
    """Reconstructions as a stream, an epoch per label: running metrics as they stand when all has been read."""
    # a pattern, as a stream's own path has to be a folder and the table may be one file
    source = spark.readStream.schema(load(spark, d, "embeddings").schema).parquet(f"{d}/embeddings.parque[t]")
    part = F.posexplode(F.array(*[F.slice("embedding", 1 + DIM * i, DIM) for i in range(4)])).alias("pos", "part")
    t = source.select("label", "vec_id", part).select(F.col("label").alias("epoch"), (F.col("vec_id") * 4 + F.col("pos")).alias("tok"), F.col("part").cast("array<double>").alias("z"))
    rows = quantize.rvq_encode(t, books(tokens(spark, d), (K, 8)), DIM).select("epoch", F.expr(f"tok div {BATCH}").alias("batch_id"), F.col("z").alias("x"), "y", "codes")
    path = shared.fresh_path(spark, "metrics")
    running.accumulate(rows, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    found = running.metrics(running.state(spark, f"{path}/state"), [K, 8])
    return found.select("epoch", "metric", F.coalesce("level", F.lit(0)).alias("level"), r6("value").alias("value"))


def rate_report(spark, d):
    fixed = quality.rate_report(2, K, 4, 64, 500.0)
    rows = stats.code_stats(quantize.level_rows(encoded(spark, d)), K, "level")
    return rows.select("level", r6("entropy_bits").alias("entropy_bits"), *[F.lit(round(v, 6)).alias(n) for n, v in fixed.items()])


def contrastive_loss(spark, d):
    t = tokens(spark, d)
    unit = lambda c: F.transform(c, lambda v: v / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)))
    views = t.select(F.expr("tok div 32").alias("batch_id"), F.col("tok").alias("item"), unit(F.col("z")).alias("a"), unit(F.transform("z", lambda v, i: v + 0.01 * i)).alias("b"))
    return quality.contrastive_loss(views).select(r6("loss").alias("loss"))


# ------------------------------------------------------------------ schedules and history


def temp_anneal(mode, spark, d):
    """The temperature of every epoch of the histories."""
    return schedule.temperatures(history(spark, d).select("run", "epoch"), 1.0, 0.1, 50, mode).select("run", "epoch", r6("temperature").alias("temperature"))


def lr_cosine_decay(spark, d):
    """The rate at which every token would be learned, a step each."""
    steps = tokens(spark, d).select(F.col("tok").alias("step"))
    return schedule.learning_rates(steps, 1e-3, 1500).select("step", F.round("rate", 9).alias("rate"))


def history(spark, d):
    """A run per user, an epoch per event."""
    f = event_frames(spark, d).select("user_id", "frame", F.posexplode("samples").alias("pos", "val_loss"))
    return f.select(F.col("user_id").alias("run"), (F.col("frame") * FRAME + F.col("pos")).alias("epoch"), "val_loss")


def early_stopping(spark, d):
    return schedule.early_stopping(history(spark, d), 12).withColumn("best_loss", r6("best_loss"))


def checkpoint_epochs(spark, d):
    return schedule.checkpoints(history(spark, d)).withColumn("val_loss", r6("val_loss"))


def best_checkpoint(spark, d):
    return schedule.best_checkpoint(history(spark, d)).withColumn("val_loss", r6("val_loss"))


# ------------------------------------------------------------------ training of the codebook


def codebook_grad(spark, d):
    t = tokens(spark, d)
    g = cb.gradient(assigned(spark, d).select("z", "code"), books(t)[0], DIM)
    return g.select("code", "dim", F.round("grad", 9).alias("grad"))


def codebook_sgd_step(spark, d):
    t = tokens(spark, d)
    return cells(cb.sgd_step(assigned(spark, d).select("z", "code"), books(t)[0], DIM, 5.0), "vec", "code")


def codebook_adam_step(spark, d):
    t = tokens(spark, d)
    g = cb.gradient(assigned(spark, d).select("z", "code"), books(t)[0], DIM)
    state = g.select("code", "dim", "e", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    return cb.adam_step(state, g, 1).select("code", "dim", r6("e").alias("e"), F.round("m", 9).alias("m"))


def rvq_joint_grad(spark, d):
    t = tokens(spark, d)
    return quantize.residual_gradients(t, books(t, (K, 8)), DIM).select("level", "code", "dim", F.round("grad", 9).alias("grad"))


def rvq_joint_adam_step(spark, d):
    t = tokens(spark, d)
    g = quantize.residual_gradients(t, books(t, (K, 8)), DIM)
    state = g.select("level", "code", "dim", "e", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    return cb.adam_step(state, g, 1, keys=("level", "code", "dim")).select("level", "code", "dim", r6("e").alias("e"), F.round("m", 9).alias("m"))


def _history(fitted):
    h = fitted.history_frame()
    return h.select("epoch", *[r6(c).alias(c) for c in h.columns[1:]])


def rvq_fit_history(spark, d):
    """All levels' codebooks, fitted jointly on the table in batches."""
    t = tokens(spark, d)
    return _history(training.fit(t, books(t, (K, 8)), DIM, training.FitConfig(3, 1024, 0.01), t))


def gs_joint_grad(spark, d):
    config = quantize.GSConfig(GK, DIM, TAU, hard=False, kl_weight=0.25)
    g = quantize.gumbel_gradients(cb.attach(soft(spark, d), _emb=gs_tables(spark)[1]), config, TAU)
    return g.select("name", "code", "dim", F.round("grad", 9).alias("grad"))


def gs_fit_history(spark, d):
    """The bottleneck's projection, bias and embedding, fitted in batches with noise while the temperature falls."""
    projection, embedding = gs_tables(spark)
    bias = spark.range(GK).select(F.col("id").cast("int").alias("code"), F.array(gs_bias(F.col("id"))).alias("vec"))
    config = quantize.GSConfig(GK, DIM, hard=False, kl_weight=0.01)
    fitting = training.FitConfig(3, 1024, 0.01, annealing=(1.0, 0.5, 3, "cosine"))
    t = tokens(spark, d)
    return _history(training.fit_gumbel(t, {"projection": projection, "bias": bias, "embedding": embedding}, config, fitting, t))


def autoencoder_fit_history(spark, d):
    """Encoder, two residual levels and decoder on the normalised frames of the events, wandering in training."""
    keys, sizes = ["user_id", "frame"], (K, 8)
    books_ = {f"codebook{i}": cb.uniform_init(spark, k, DIM, SEED, i, 1.0) for i, k in enumerate(sizes, 1)}
    wander = lambda df, epoch: df.withColumn("samples", signals.add_wander(F.col("samples"), (0.0, 0.2), (0.5, 1.5), SLOW, F.lit(epoch), *map(F.col, keys), seed=SEED))
    frames = norm_frames(spark, d)
    fitted = training.fit_autoencoder(frames, keys, _weights(), backprop.Residual(quantize.RVQConfig(2, sizes, DIM)), books_, training.FitConfig(2, 48, 0.005), frames, wander)
    return _history(fitted)


def codebook_neighbours(spark, d):
    return cb.nearest_codes(books(tokens(spark, d))[0]).withColumn("dist", r6("dist"))


# ------------------------------------------------------------------ neural blocks


def conv1d_same_stride2(spark, d):
    return cells(full_frames(spark, d).withColumn("x", nn.conv_column(F.col("samples"), TAPS, 2, FRAME)), "x", "user_id", "frame")


def channel_layernorm(spark, d):
    return cells(tokens(spark, d).withColumn("x", nn.channel_norm_column(F.col("z"))), "x", "tok")


def upsample_nearest(spark, d):
    return cells(full_frames(spark, d).withColumn("x", nn.upsample_column(F.col("samples"))), "x", "user_id", "frame")


def separable_conv(spark, d):
    x = full_frames(spark, d).withColumn("x", F.flatten(nn.separable_column(F.col("samples"), DEEP, POINT, FRAME)))
    return cells(x, "x", "user_id", "frame")


def gelu(spark, d):
    return load(spark, d, "events").select("event_id", r6(columns.gelu(F.col("value") / 100 - 1)).alias("y"))


def _by_channel(df, array, *keys):
    return df.select(*keys, F.posexplode(array).alias("pos", "c")).select(*keys, "pos", F.posexplode("c").alias("dim", "v")).withColumn("v", r6("v"))


def encoder_block(spark, d):
    x = F.transform("samples", lambda v: F.array(v))
    return _by_channel(norm_frames(spark, d).withColumn("x", nn.down_block_column(x, _weights(), "down1", FRAME)), "x", "user_id", "frame")


def decoder_block(spark, d):
    x = F.array(*[F.slice("embedding", 1 + DIM * i, DIM).cast("array<double>") for i in range(4)])
    return _by_channel(load(spark, d, "embeddings").withColumn("x", nn.up_block_column(x, _weights(), "up4", 4)), "x", "vec_id")


def _weights():
    return nn.Weights.draw(base=4, dim=DIM, seed=SEED)


def norm_frames(spark, d):
    return full_frames(spark, d).withColumn("samples", signals.normalise(F.col("samples")))


def encoder_16x(spark, d):
    return cells(nn.encode_frames(norm_frames(spark, d), _weights(), ["user_id", "frame"]), "z", "user_id", "frame", "pos")


def decoder_16x(spark, d):
    t = tokens(spark, d).select(F.expr("tok div 4").alias("vec_id"), (F.col("tok") % 4).alias("pos"), F.col("z").alias("y"))
    return cells(nn.decode_frames(t, _weights(), ["vec_id"]), "samples", "vec_id")


def _codec(spark, d):
    sizes = (K, 8)
    return RVQCodec(quantize.RVQConfig(2, sizes, DIM), _weights(), [cb.uniform_init(spark, k, DIM, SEED, i, 1.0) for i, k in enumerate(sizes, 1)])


def codec_roundtrip(spark, d):
    out = _codec(spark, d).round_trip(norm_frames(spark, d), ["user_id", "frame"])
    return _by_frame(out)


def _by_frame(out, source="user_id"):
    error = squared_distance(F.col("x"), F.col("y")) / F.size("x")
    norm = F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y")))
    return out.select(source, "frame", r6(error).alias("mse"), r6(F.when(norm > 0, dot(F.col("x"), F.col("y")) / norm).otherwise(0.0)).alias("cosine"))


def codec_full_size(spark, d):
    """The model at its full size on long frames: 4096 samples, two levels of 256 codes, 16 numbers a token, base 32.
    Series are prices by line number."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    series = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("source"), *keys, "l_extendedprice")
    f = signals.frames(series, "source", keys, "l_extendedprice", 4096, F.expr("l_orderkey div 100000")).where(F.size("samples") == 4096)
    f = f.withColumn("samples", signals.normalise(F.col("samples")))
    codec = RVQCodec(quantize.RVQConfig(2, 256, DIM), nn.Weights.draw(base=32, dim=DIM, seed=SEED), [cb.uniform_init(spark, 256, DIM, SEED, i, 1.0) for i in (1, 2)])
    return _by_frame(codec.round_trip(f, ["source", "frame"]), "source")


def gs_codec_roundtrip(spark, d):
    """As in training: with noise, and a projection of the latents."""
    codec = GumbelCodec(quantize.GSConfig(GK, DIM, TAU), _weights(), *gs_tables(spark), gs_bias)
    return _by_frame(codec.round_trip(norm_frames(spark, d), ["user_id", "frame"], 7))


def gs_codec_logits(spark, d):
    """Without a projection: the encoder's output are the logits, the likeliest as they are."""
    codec = GumbelCodec(quantize.GSConfig(GK, DIM, TAU, input_is_logits=True), nn.Weights.draw(base=4, dim=GK, out=DIM, seed=SEED), None, gs_tables(spark)[1])
    return _by_frame(codec.round_trip(norm_frames(spark, d), ["user_id", "frame"]))


QUERIES = {
    f.__name__: f
    for f in (
        signal_split, signal_shuffle_order, signal_frames, signal_union, frame_batch_drop_remainder, frame_layernorm, frame_crop, frame_pairs, frame_time_axis,
        frame_noise, frame_sine, frame_amplitude, frame_cutout, frame_amplitude_warp, frame_wander, frame_powerline, frame_gaussian_noise, frame_background,
        codebook_uniform_init, vq_distance, vq_assign, vq_dequantize, vq_loss, vq_histogram, vq_stats_batch_mean, vq_stats_global,
        rvq_encode, rvq_mixed_k, rvq_decode, rvq_level_loss, rvq_level_stats, rvq_summary_stats,
        gs_weights, gs_logits, gs_logits_passthrough, gs_softmax, gs_gumbel_noise, gs_gumbel_softmax, gs_index, gs_expected_embedding, gs_hard_embedding, gs_token_entropy, gs_kl_bits, gs_kl_loss, gs_stats,
        recon_weighted_mse, total_loss, train_metrics, stream_metrics, rate_report, contrastive_loss,
        lr_cosine_decay, early_stopping, checkpoint_epochs, best_checkpoint,
        codebook_grad, codebook_sgd_step, codebook_adam_step, codebook_neighbours, rvq_joint_grad, rvq_joint_adam_step, rvq_fit_history, gs_joint_grad, gs_fit_history, autoencoder_fit_history,
        conv1d_same_stride2, channel_layernorm, upsample_nearest, separable_conv, gelu, encoder_block, decoder_block, encoder_16x, decoder_16x, codec_roundtrip, codec_full_size, gs_codec_roundtrip, gs_codec_logits,
    )
}
QUERIES |= {
    "contrastive_loss_all": contrastive_loss,  # an earlier name
    "rvq_decode_prefix": partial(rvq_decode, levels=1),
    "recon_mse": partial(_recon, quality.mse),
    "recon_cosine": partial(_recon, quality.cosine),
    "recon_d_loss": partial(_recon, quality.derivative_loss),
    "recon_prd_percent": partial(_recon, quality.prd_percent),
    "recon_prd_normalised": partial(_recon, quality.prd_normalised),
    "temp_anneal_cosine": partial(temp_anneal, "cosine"),
    "temp_anneal_exp": partial(temp_anneal, "exp"),
}
