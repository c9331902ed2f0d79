"""Vector quantization: one level, residual levels, and a Gumbel-softmax bottleneck. Tokens are (tok, z)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions.columns import EPSILON, checked, dot, hash_uniform, minus, nearest, plus, softmax, squared_distance, total
from waveloom.operators import stats
from waveloom.operators.codebook import attach


@dataclass(frozen=True)
class VQConfig:
    num_embeddings: int
    embedding_dim: int
    beta: float = 0.25

    def __post_init__(self):
        if self.num_embeddings <= 0 or self.embedding_dim <= 0 or self.beta <= 0:
            raise ValueError("num_embeddings, embedding_dim and beta are above 0")


@dataclass(frozen=True)
class RVQConfig:
    num_levels: int
    num_embeddings: int | tuple[int, ...]
    embedding_dim: int
    beta: float = 0.25

    def __post_init__(self):
        if self.num_levels < 1 or self.embedding_dim <= 0 or self.beta <= 0:
            raise ValueError("num_levels is 1 or more, embedding_dim and beta are above 0")
        sizes = self.num_embeddings
        sizes = (sizes,) * self.num_levels if isinstance(sizes, int) else tuple(sizes)
        if len(sizes) != self.num_levels or min(sizes) <= 0:
            raise ValueError("a number of codes above 0 for each level")
        object.__setattr__(self, "num_embeddings", sizes)


@dataclass(frozen=True)
class GSConfig:
    num_embeddings: int
    embedding_dim: int
    temperature: float = 1.0
    hard: bool = True
    input_is_logits: bool = False
    use_bias: bool = True
    kl_weight: float = 1.0

    def __post_init__(self):
        if self.num_embeddings < 2 or self.embedding_dim <= 0:
            raise ValueError("num_embeddings is 2 or more, embedding_dim above 0")


# ------------------------------------------------------------------ one level


def distances(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """(tok, code, dist) of every token and codeword."""
    joined = attach(tokens, codebook=codebook)
    all_ = F.transform("codebook", lambda e: squared_distance(F.col("z"), e))
    return joined.select("tok", F.posexplode(all_).alias("code", "dist"))


def assign(tokens: DataFrame, codebook: DataFrame, dim: int) -> DataFrame:
    """tokens with code, dist and q, the codeword (what a straight-through layer hands on)."""
    joined = attach(tokens.withColumn("z", checked(F.col("z"), dim)), codebook=codebook)
    found = joined.withColumn("_near", nearest(F.col("z"), F.col("codebook"))).drop("codebook")
    return found.select(*tokens.columns, F.col("_near.code").alias("code"), F.col("_near.dist").alias("dist"), F.col("_near.vec").alias("q"))


def dequantize(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """codes (tok, code) with q."""
    joined = attach(codes, codebook=codebook)
    return joined.withColumn("q", F.element_at("codebook", F.col("code") + 1)).drop("codebook")


def layer_loss(dist: Column, dim: int, beta: float) -> Column:
    """Aggregate: commitment and codebook loss of rows with a squared distance."""
    return F.sum(dist) / (F.count(F.lit(1)) * dim) * (1 + beta)


def losses(assigned: DataFrame, dim: int, beta: float) -> DataFrame:
    """One row: commitment and codebook loss, means over all numbers of all tokens."""
    mse = F.sum("dist") / (F.count(F.lit(1)) * dim)
    return assigned.agg((mse * beta).alias("commitment"), mse.alias("codebook"), (mse * (1 + beta)).alias("total"))


# ------------------------------------------------------------------ residual levels


def rvq_encode(tokens: DataFrame, codebooks: list[DataFrame], dim: int) -> DataFrame:
    """tokens with codes, dists (one per level) and y, the sum of the codewords. Level by level, each on
    what the ones before leave; one projection per level, no shuffle."""
    names = {f"_cb{i}": c for i, c in enumerate(codebooks, 1)}
    df = attach(tokens.withColumn("_rest", checked(F.col("z"), dim)), **names)
    for i, name in enumerate(names, 1):
        df = df.withColumn(f"_near{i}", nearest(F.col("_rest"), F.col(name)))
        df = df.withColumn("_rest", minus(F.col("_rest"), F.col(f"_near{i}.vec")))
    levels = range(1, len(codebooks) + 1)
    y = F.col("_near1.vec")
    for i in levels[1:]:
        y = plus(y, F.col(f"_near{i}.vec"))
    return df.select(
        *tokens.columns,
        F.array(*[F.col(f"_near{i}.code") for i in levels]).alias("codes"),
        F.array(*[F.col(f"_near{i}.dist") for i in levels]).alias("dists"),
        y.alias("y"),
    )


def rvq_arrays(held: DataFrame, codebooks: list[DataFrame], dim: int, latent: str = "latent") -> DataFrame:
    """``held`` with codes and y of every token of a row's latent (arrays of as many): level by level over the whole
    array, so a frame is encoded where it stands."""
    names = {f"_cb{i}": c for i, c in enumerate(codebooks, 1)}
    df = attach(held.withColumn("_rest", F.transform(latent, lambda z: checked(z, dim))), **names)
    for i, book in enumerate(map(F.col, names), 1):
        df = df.withColumn(f"_near{i}", F.transform("_rest", lambda z: nearest(z, book)))  # noqa: B023
        df = df.withColumn("_rest", F.zip_with("_rest", f"_near{i}", lambda z, n: minus(z, n["vec"])))
    y = F.col("_near1.vec")
    for i in range(2, len(codebooks) + 1):
        y = F.zip_with(y, F.col(f"_near{i}.vec"), lambda a, b: plus(a, b))
    codes = F.arrays_zip(*[F.col(f"_near{i}.code").alias(f"level{i}") for i in range(1, len(codebooks) + 1)])
    return df.select(*held.columns, codes.alias("codes"), y.alias("y"))


def rvq_decode(codes: DataFrame, codebooks: list[DataFrame], levels: int | None = None) -> DataFrame:
    """codes (tok, codes) with y, from the first ``levels`` levels."""
    levels = len(codebooks) if levels is None else min(levels, len(codebooks))
    if levels < 1:
        raise ValueError("a level at least")
    df = attach(codes, **{f"_cb{i}": codebooks[i - 1] for i in range(1, levels + 1)})
    part = lambda i: F.element_at(F.col(f"_cb{i}"), F.element_at("codes", i) + 1)
    y = part(1)
    for i in range(2, levels + 1):
        y = plus(y, part(i))
    return df.select(*codes.columns, y.alias("y"))


def level_rows(encoded: DataFrame) -> DataFrame:
    """(tok, level, code, dist): a row per token and level."""
    zipped = F.posexplode(F.arrays_zip("codes", "dists")).alias("at", "held")
    keep = [c for c in encoded.columns if c not in ("codes", "dists", "y", "z")]
    return encoded.select(*keep, zipped).select(*keep, (F.col("at") + 1).alias("level"), F.col("held.codes").alias("code"), F.col("held.dists").alias("dist"))


def level_sums(tokens: DataFrame, codebooks: list[DataFrame], dim: int) -> DataFrame:
    """(level, code, dim, n, s): of each level's codewords the number and the sum of the residuals that fall to them, and
    as one dimension more (dim is the vectors' length) the sum of their squared errors. All levels in one grouping that
    is summed map-side: as many rows as the codebooks have numbers. A level's residuals are held fixed, so no level's
    loss moves the codewords before it."""
    names = {f"_cb{i}": c for i, c in enumerate(codebooks, 1)}
    df = attach(tokens.select(checked(F.col("z"), dim).alias("_rest1")), **names)
    for i, name in enumerate(names, 1):
        df = df.withColumn(f"_near{i}", nearest(F.col(f"_rest{i}"), F.col(name)))
        df = df.withColumn(f"_rest{i + 1}", minus(F.col(f"_rest{i}"), F.col(f"_near{i}.vec")))
    row = lambda i: F.struct(F.lit(i).alias("level"), F.col(f"_near{i}.code").alias("code"), F.concat(F.col(f"_rest{i}"), F.array(F.col(f"_near{i}.dist"))).alias("values"))
    rows = df.select(F.explode(F.array(*[row(i) for i in range(1, len(codebooks) + 1)])).alias("r")).select("r.level", "r.code", F.posexplode("r.values").alias("dim", "v"))
    return rows.groupBy("level", "code", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))


def residual_gradients(tokens: DataFrame, codebooks: list[DataFrame], dim: int) -> DataFrame:
    """(level, code, dim, e, grad) of the codebook losses of all levels: 2 / (N D) (n e - sum of residuals)."""
    sums = level_sums(tokens, codebooks, dim)
    cells = None
    for level, book in enumerate(codebooks, 1):
        own = book.select(F.lit(level).alias("level"), "code", F.posexplode("vec").alias("dim", "e"))
        cells = own if cells is None else cells.unionByName(own)
    # a level's tokens are counted at the extra dimension, which every codeword in use has once
    n_all = sums.where(f"dim = {dim} and level = 1").agg(F.sum("n").alias("n_all"))
    grad = F.lit(2.0) / (F.col("n_all") * dim) * (F.coalesce("n", F.lit(0)) * F.col("e") - F.coalesce("s", F.lit(0.0)))
    return cells.join(sums, ["level", "code", "dim"], "left").join(F.broadcast(n_all)).select("level", "code", "dim", "e", grad.alias("grad"))


# ------------------------------------------------------------------ Gumbel softmax


def logits(tokens: DataFrame, projection: DataFrame, bias: Column | None = None) -> DataFrame:
    """tokens with logits: z times each row of the projection (code, vec), plus a bias by code."""
    joined = attach(tokens, _proj=projection)
    score = F.transform("_proj", lambda w, k: dot(F.col("z"), w) + (bias(k) if bias is not None else 0.0))
    return joined.withColumn("logits", score).drop("_proj")


def gumbel(u: Column) -> Column:
    """-ln(-ln(u + 1e-9) + 1e-9); the inner term is held above 0, as doubles can push it there."""
    return -F.ln(F.greatest(-F.ln(u + 1e-9) + 1e-9, F.lit(1e-300)))


def gumbel_noise(key: Column, codes: int, seed: int) -> Column:
    """What :func:`posteriors` adds to a token's logits under a seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(codes - 1)), lambda k: gumbel(hash_uniform(seed, key, k)))


def posteriors(scored: DataFrame, temperature: float = 1.0, noise_seed: int | None = None, key: str = "tok") -> DataFrame:
    """scored (tok, logits) with p. With a seed as in training: (logits + noise) / temperature; without:
    logits over the temperature, at least 1e-6."""
    if noise_seed is None:
        return scored.withColumn("p", softmax(F.col("logits"), max(temperature, 1e-6)))
    if temperature <= 0:
        raise ValueError("the temperature is above 0")
    noisy = F.transform("logits", lambda v, k: v + gumbel(hash_uniform(noise_seed, F.col(key), k)))
    return scored.withColumn("p", softmax(noisy, temperature))


def kl_loss(posteriors: DataFrame, config: GSConfig, *by: str) -> DataFrame:
    """(by, total): the bottleneck's rate term, its weight times the bits that a mean token's posterior is from
    uniform. A weight of 0 adds nothing."""
    bits = stats.kl_bits(posteriors, config.num_embeddings, *by)
    return bits.select(*by, (F.lit(float(config.kl_weight)) * F.col("kl_bits")).alias("total"))


def hard_index(p: Column) -> Column:
    """The likeliest code; of equals the first."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected_embedding(p: Column, embedding: Column, dim: int) -> Column:
    """The mean codeword under p. This is the forward value whether selection is hard or soft."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: total(F.zip_with(p, embedding, lambda w, e: w * F.get(e, d))))


def hard_embedding(p: Column, embedding: Column) -> Column:
    """The likeliest code's own codeword."""
    return F.element_at(embedding, hard_index(p) + 1)


def gumbel_sums(soft: DataFrame, config: GSConfig, temperature: float, embedding: str = "_emb") -> DataFrame:
    """(code, place, s) of the gradients of a bottleneck that rebuilds its own latents: rows (z, p) with the embedding
    attached, summed map-side in one grouping, as many rows as the parameters are. The loss is the mean squared error of
    the expected codeword plus the rate term. places of a code: the embedding's numbers, the projection's, the bias.
    Code -1 has the sums of squared errors and of p ln p, and the tokens. Sums are over tokens: divide by their number.

    Hard selection takes gradients through the one-hot code, which has none, so then only the rate term reaches the
    logits; soft selection hands them through the Jacobian of the softmax, p (g - sum of p g)."""
    d, e = config.embedding_dim, F.col(embedding)
    held = soft.withColumn("_y", expected_embedding(F.col("p"), e, d))
    held = held.withColumn("_gy", F.zip_with("_y", "z", lambda y, z: (y - z) * (2.0 / d)))
    log_p = F.transform("p", lambda v: F.ln(v + EPSILON))
    rate = F.zip_with("p", log_p, lambda v, l: (l + v / (v + EPSILON)) * F.lit(config.kl_weight / math.log(2)))  # noqa: E741
    of_p = rate if config.hard else F.zip_with(rate, F.transform(e, lambda w: dot(F.col("_gy"), w)), lambda a, b: a + b)
    held = held.withColumn("_gp", of_p).withColumn("_inner", dot(F.col("p"), F.col("_gp")))
    held = held.withColumn("_gl", F.zip_with("p", "_gp", lambda v, g: v * (g - F.col("_inner")) / F.lit(temperature)))
    row = lambda v, k: F.struct(k.alias("code"), F.concat(F.transform("_gy", lambda g: g * v), F.transform("z", lambda z: z * F.get("_gl", k)), F.array(F.get("_gl", k))).alias("values"))
    own = F.struct(F.lit(-1).alias("code"), F.array(squared_distance(F.col("_y"), F.col("z")), dot(F.col("p"), log_p), F.lit(1.0)).alias("values"))
    rows = held.select(F.explode(F.concat(F.transform("p", row), F.array(own))).alias("r")).select("r.code", F.posexplode("r.values").alias("place", "v"))
    return rows.groupBy("code", "place").agg(F.sum("v").alias("s"))


def gumbel_gradients(soft: DataFrame, config: GSConfig, temperature: float, embedding: str = "_emb") -> DataFrame:
    """(name, code, dim, grad) of embedding, projection and bias: means of :func:`gumbel_sums` over the tokens."""
    sums = gumbel_sums(soft, config, temperature, embedding)
    n, d = sums.where("code = -1 and place = 2").select(F.col("s").alias("_n")), config.embedding_dim
    name = F.when(F.col("place") < d, "embedding").when(F.col("place") < 2 * d, "projection").otherwise("bias")
    return sums.where("code >= 0").join(F.broadcast(n)).select(name.alias("name"), "code", (F.col("place") % d).cast("int").alias("dim"), (F.col("s") / F.col("_n")).alias("grad"))
