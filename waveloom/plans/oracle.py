"""DuckDB SQL of the queries, put together from common table expressions."""

from __future__ import annotations

import numpy as np

from waveloom.operators import nn
from waveloom.plans.queries import BATCH, DEEP, DIM, FRAME, GK, K, POINT, SEED, SLOW, TAPS, TAU

LN2, EPS = "ln(2::DOUBLE)", "1e-10::DOUBLE"



def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def total(x: str) -> str:
    return f"coalesce(list_sum({x}), 0::DOUBLE)"


def sq(a: str, b: str) -> str:
    return total(f"list_transform(range(1, {DIM + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))")


TOK = f"""tok AS (SELECT vec_id * 4 + p AS tok, list_transform(embedding[p * {DIM} + 1 : p * {DIM} + {DIM}], lambda x: x::DOUBLE) AS z
    FROM embeddings, (SELECT unnest(range(4)) AS p))"""
#: Second codebooks start after the first's 16 tokens.
CB1 = f"cb1 AS (SELECT tok::INT AS code, z AS vec FROM tok WHERE tok < {K})"


def cb2(k: int = K) -> str:
    return f"cb2 AS (SELECT (tok - {K})::INT AS code, list_transform(z, lambda x: x * 0.25::DOUBLE) AS vec FROM tok WHERE tok >= {K} AND tok < {K + k})"


def near(source: str, column: str, book: str, out: str) -> str:
    """out: source's rows with code, dist, vec of the nearest codeword."""
    return f"""{out} AS (SELECT * EXCLUDE (rn) FROM (SELECT s.*, b.code, {sq('s.' + column, 'b.vec')} AS dist, b.vec,
        row_number() OVER (PARTITION BY s.tok ORDER BY {sq('s.' + column, 'b.vec')}, b.code) AS rn FROM {source} s, {book} b) WHERE rn = 1)"""


ASSIGNED = f"WITH {TOK}, {CB1}, {near('tok', 'z', 'cb1', 'a')}"


def encoded(k: int = K) -> str:
    minus = f"list_transform(range(1, {DIM + 1}), lambda i: z[i] - vec[i])"
    return f"""WITH {TOK}, {CB1}, {cb2(k)}, {near('tok', 'z', 'cb1', 'n1')},
    r AS (SELECT tok, z, code AS c1, dist AS d1, vec AS v1, {minus} AS rest FROM n1),
    {near('r', 'rest', 'cb2', 'n2')},
    enc AS (SELECT tok, z AS x, c1, d1, code AS c2, dist AS d2, v1, list_transform(range(1, {DIM + 1}), lambda i: v1[i] + vec[i]) AS y FROM n2),
    lev AS (SELECT tok, 1 AS level, c1 AS code, d1 AS dist FROM enc UNION ALL SELECT tok, 2, c2, d2 FROM enc)"""


def cells(table: str, column: str, *keys: str, n: int | str = DIM) -> str:
    head = ", ".join([*keys, ""])
    return f"SELECT {head}(i - 1)::INT AS dim, round({column}[i], 6) + 0 AS v FROM {table}, (SELECT unnest(range(1, {n} + 1)) AS i)"


def full_batches(table: str, out: str = "bt") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT *, tok // {BATCH} AS batch_id, count(*) OVER (PARTITION BY tok // {BATCH}) AS n_b FROM {table}) WHERE n_b = {BATCH})"""


def code_stats(table: str, by: str, size: str) -> str:
    """per: by, entropy_bits, perplexity, usage."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""h AS (SELECT {key}code, count(*) AS n FROM {table} GROUP BY {key}code),
    hp AS (SELECT *, n / (sum(n) OVER ({part}))::DOUBLE AS p FROM h),
    e AS (SELECT {key}-sum(p * ln(p + {EPS})) / {LN2} AS entropy_bits, count(*) AS used FROM hp {group}),
    per AS (SELECT {key}entropy_bits, exp(entropy_bits * {LN2}) AS perplexity, used / ({size})::DOUBLE AS usage FROM e)"""


STATS = ", ".join(f"round({f}({c}), 6) AS {c}" for c, f in (("entropy_bits", "{f}"), ("perplexity", "{f}"), ("usage", "{f}")))
MEANS, PLAIN = STATS.replace("{f}", "avg"), STATS.replace("{f}", "")

FRAMES = f"""s AS (SELECT user_id, value::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
    fr AS (SELECT user_id, (place // {FRAME})::INT AS frame, list(x ORDER BY place) AS samples FROM s GROUP BY user_id, place // {FRAME}),
    ff AS (SELECT * FROM fr WHERE len(samples) = {FRAME})"""
HISTORY = "hist AS (SELECT user_id AS run, place::INT AS epoch, x AS val_loss FROM s)"
HASH = lambda *k: f"md5(concat_ws(':', {', '.join(k)}))"


def frame_cells(expression: str, n: int | str = FRAME, table: str = "ff") -> str:
    return f"WITH {FRAMES}, y AS (SELECT user_id, frame, {expression} AS x FROM {table}) " + cells("y", "x", "user_id", "frame", n=n)


def norm(x: str, n: str, eps: str) -> str:
    mean = f"({total(x)} / {n})"
    var = f"({total(f'list_transform({x}, lambda v: (v - {mean}) * (v - {mean}))')} / {n})"
    return f"list_transform({x}, lambda v: (v - {mean}) / sqrt({var} + {eps}::DOUBLE))"


def init(name: str, k: int, level: int, bound: str) -> str:
    value = f"({uniform(f'{SEED!r}', str(level), 'code', 'd')} * 2 - 1) * {bound}"
    return f"{name} AS (SELECT code, list({value} ORDER BY d) AS vec FROM (SELECT unnest(range({k}))::INT AS code), (SELECT unnest(range({DIM}))::INT AS d) GROUP BY code)"


PROJ, EMB = init("proj", GK, 11, "0.25::DOUBLE"), init("emb", GK, 12, f"(1::DOUBLE / {GK})")
BIAS = f"{uniform(str(SEED), '13', 'code')} * 0.1::DOUBLE"
SCORED = f"""{TOK}, {PROJ}, {EMB},
    sc AS (SELECT tok, code, {total(f'list_transform(range(1, {DIM + 1}), lambda i: z[i] * vec[i])')} + {BIAS} AS l FROM tok, proj)"""


def softmax(value: str, table: str = "sc", out: str = "p") -> str:
    return f"""{out}_m AS (SELECT tok, code, {value} AS l, max({value}) OVER (PARTITION BY tok) AS top FROM {table}),
    {out} AS (SELECT tok, code, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY tok) AS p FROM {out}_m)"""


NOISE = f"-ln(greatest(-ln({uniform('7', 'tok', 'code')} + 1e-9::DOUBLE) + 1e-9::DOUBLE, 1e-300::DOUBLE))"
SOFT = f"WITH {SCORED}, {softmax(f'l / {TAU}::DOUBLE')}"
NATS = f"nats AS (SELECT tok, -sum(p * ln(p + {EPS})) AS nats FROM p GROUP BY tok)"
TOP = "top AS (SELECT tok, arg_min(code, (-p, code)) AS code FROM (SELECT tok, code, p FROM p) GROUP BY tok)"
KL = f"kl AS (SELECT batch_id, (ln({GK}::DOUBLE) - avg(nats)) / {LN2} AS kl_bits FROM bn GROUP BY batch_id)"
TOK_CELL = "SELECT tok, code AS dim, round({}, 6) + 0 AS v FROM {}"

MSE = f"sum({sq('x', 'y')}) / (count(*) * {DIM})"
D_LOSS = f"0.2::DOUBLE * sum({total(f'list_transform(range(1, {DIM}), lambda i: abs((x[i + 1] - x[i]) - (y[i + 1] - y[i])))')}) / (count(*) * {DIM - 1})"
DOT = lambda a, b: total(f"list_transform(range(1, {DIM + 1}), lambda i: {a}[i] * {b}[i])")
COSINE = f"avg({DOT('x', 'y')} / (sqrt({DOT('x', 'x')}) * sqrt({DOT('y', 'y')})))"


def recon(expression: str) -> str:
    return f"{encoded()} SELECT round({expression}, 6) AS value FROM enc"


def conv(taps: list[float], stride: int, left: int) -> str:
    kernel = "[" + ", ".join(f"{t}::DOUBLE" for t in taps) + "]"
    n = -(-FRAME // stride)
    return f"list_transform(range({n}), lambda o: {total(f'list_transform(range(1, {len(taps) + 1}), lambda k: coalesce(CASE WHEN o * {stride} + k - {left} >= 1 THEN samples[o * {stride} + k - {left}] END, 0) * {kernel}[k])')})"


def anneal(mode: str) -> str:
    t = "(least(epoch, 50) / 50::DOUBLE)"
    value = f"0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * {t}))" if mode == "cosine" else f"1::DOUBLE * pow(0.1::DOUBLE, {t})"
    return f"WITH {FRAMES}, {HISTORY} SELECT run, epoch, round({value}, 6) AS temperature FROM hist"


def of_vectors(name: str, level: int, bound: str) -> str:
    value = f"({uniform(f'{SEED!r}', str(level), 'code', 'd')} * 2 - 1) * {bound}"
    return f"{name} AS (SELECT code, list({value} ORDER BY d) AS vec FROM (SELECT vec_id AS code FROM embeddings), (SELECT unnest(range({DIM}))::INT AS d) GROUP BY code)"


# ------------------------------------------------------------------ drawn augmenters


def between(low: float, high: float, *parts: str, key: str = "user_id, frame") -> str:
    return f"({low}::DOUBLE + {uniform(str(SEED), key, *parts)} * ({high} - {low})::DOUBLE)"


def curve_cells(point: str, value: str) -> str:
    """value over x (the sample), g (the curve through points at a drawn frequency)."""
    return f"""WITH {FRAMES}, q AS (SELECT user_id, frame, (i - 1)::INT AS dim, samples[i] AS x, {between(0.5, 1.5, "'frequency'")} AS f, (i - 1) * {between(0.5, 1.5, "'frequency'")} / {SLOW}::DOUBLE AS place FROM ff, (SELECT unnest(range(1, {FRAME + 1})) AS i)),
    w AS (SELECT *, floor(place)::INT AS j FROM q),
    h AS (SELECT *, {point.format(j='j')} + ({point.format(j='(j + 1)')} - {point.format(j='j')}) * (place - j) AS g FROM w)
    SELECT user_id, frame, dim, round({value}, 6) + 0 AS v FROM h"""


GRAD = f"""{ASSIGNED}, n AS (SELECT count(*) AS n_all FROM a),
    u AS (SELECT code, i - 1 AS dim, sum(z[i]) AS s, count(*) AS n FROM a, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY ALL),
    c AS (SELECT code, i - 1 AS dim, vec[i] AS e FROM cb1, (SELECT unnest(range(1, {DIM + 1})) AS i)),
    g AS (SELECT c.code, c.dim::INT AS dim, e, 2::DOUBLE / (n_all * {DIM}) * (coalesce(n, 0) * e - coalesce(s, 0)) AS grad FROM c LEFT JOIN u USING (code, dim), n)"""
SIZE = f"CASE level WHEN 1 THEN {K} ELSE 8 END"

ORACLE_SQL = {
    "signal_split": f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {HASH(str(SEED), 'user_id')}, user_id) - 1 AS rank, count(*) OVER () AS n FROM u)
        SELECT user_id, rank, CASE WHEN rank < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
    "signal_shuffle_order": f"SELECT event_id, row_number() OVER (ORDER BY {HASH(str(SEED), '1', 'event_id')}, event_id) - 1 AS place FROM events",
    "signal_frames": f"WITH {FRAMES} SELECT user_id, frame, len(samples)::INT AS n, round(samples[1], 6) AS first_value, round(samples[-1], 6) AS last_value FROM fr",
    "signal_union": "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id",
    "frame_batch_drop_remainder": f"""WITH {FRAMES}, pl AS (SELECT user_id, frame, row_number() OVER (ORDER BY {HASH(str(SEED), '0', 'user_id', 'frame')}, user_id, frame) - 1 AS place FROM ff)
        SELECT * EXCLUDE (n) FROM (SELECT *, place // 32 AS batch_id, count(*) OVER (PARTITION BY place // 32) AS n FROM pl) WHERE n = 32""",
    "frame_layernorm": f"WITH {FRAMES}, y AS (SELECT user_id, frame, {norm('samples', 'len(samples)', '0.001')} AS x FROM fr) SELECT user_id, frame, (i - 1)::INT AS dim, round(x[i], 6) AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM y)",
    "frame_crop": frame_cells(f"list_slice(samples, 1 + floor({uniform(str(SEED), 'user_id', 'frame')} * 9)::INT, 8 + floor({uniform(str(SEED), 'user_id', 'frame')} * 9)::INT)", 8),
    "frame_pairs": f"WITH {FRAMES} SELECT user_id, frame, (i - 1)::INT AS dim, round(samples[i], 6) AS x, round(samples[i], 6) AS y FROM ff, (SELECT unnest(range(1, {FRAME + 1})) AS i)",
    "frame_time_axis": f"WITH {FRAMES} SELECT user_id, frame, (i - 1)::INT AS pos, round((i - 1) / 500::DOUBLE, 6) AS seconds, round(samples[i], 6) AS x FROM ff, (SELECT unnest(range(1, {FRAME + 1})) AS i)",
    "frame_noise": frame_cells(f"list_transform(range(1, {FRAME + 1}), lambda i: samples[i] + ({uniform(str(SEED), 'user_id', 'frame', 'i - 1')} * 2 - 1) * 0.5::DOUBLE)"),
    "frame_sine": frame_cells(f"list_transform(range(1, {FRAME + 1}), lambda i: samples[i] + 0.3::DOUBLE * sin((i - 1) * {6.283185307179586 * 50 / 500}::DOUBLE))"),
    "frame_amplitude": frame_cells(f"list_transform(samples, lambda v: v * (1 + ({uniform(str(SEED), 'user_id', 'frame')} * 2 - 1) * 0.1::DOUBLE))"),
    "frame_cutout": frame_cells(f"list_transform(range(1, {FRAME + 1}), lambda i: CASE WHEN i - 1 >= floor({uniform(str(SEED), 'user_id', 'frame')} * 13) AND i - 1 < floor({uniform(str(SEED), 'user_id', 'frame')} * 13) + 4 THEN 0::DOUBLE ELSE samples[i] END)"),
    "frame_amplitude_warp": curve_cells(between(0.9, 1.1, "'factor'", "{j}"), "x * g"),
    "frame_wander": curve_cells(between(-1.0, 1.0, "'point'", "{j}"), f"x + {between(0.0, 1.0, chr(39) + 'amplitude' + chr(39))} * g"),
    "frame_powerline": frame_cells(f"list_transform(range(1, {FRAME + 1}), lambda i: samples[i] + {between(0.0, 0.05, chr(39) + 'amplitude' + chr(39))} * sin(2 * pi() * ((i - 1) * {between(45.0, 50.0, chr(39) + 'frequency' + chr(39))} / 500 + {uniform(str(SEED), 'user_id', 'frame', chr(39) + 'phase' + chr(39))})))"),
    "frame_gaussian_noise": frame_cells(f"""list_transform(range(1, {FRAME + 1}), lambda i: samples[i] + {between(0.1, 0.5, "'deviation'")} * sqrt(-2 * ln(1 - {uniform(str(SEED), 'user_id', 'frame', 'i - 1', "'radius'")})) * cos(2 * pi() * {uniform(str(SEED), 'user_id', 'frame', 'i - 1', "'angle'")}))"""),
    "frame_background": f"""WITH {FRAMES}, nf AS (SELECT user_id, (place // 24)::INT AS frame, list(x ORDER BY place) AS noise FROM s GROUP BY user_id, place // 24),
        nr AS (SELECT noise, row_number() OVER (ORDER BY {HASH(str(SEED), '3', 'user_id', 'frame')}, user_id, frame) - 1 AS place, count(*) OVER () AS n FROM nf),
        pk AS (SELECT user_id, frame, p, samples, floor({uniform(str(SEED), 'user_id', 'frame', "'pick'", 'p')} * (SELECT max(n) FROM nr))::BIGINT AS pick FROM ff, (SELECT unnest(range(2)) AS p)),
        mx AS (SELECT user_id, frame, p, samples, {between(0.05, 0.2, "'amplitude'", 'p')} AS a, floor({uniform(str(SEED), 'user_id', 'frame', "'begin'", 'p')} * len(noise))::INT AS b, noise FROM pk JOIN nr ON pick = place)
        SELECT user_id, frame, (i - 1)::INT AS dim, round(any_value(samples[i]) + sum(a * noise[(b + i - 1) % len(noise) + 1]), 6) + 0 AS v FROM mx, (SELECT unnest(range(1, {FRAME + 1})) AS i) GROUP BY user_id, frame, i""",
    "codebook_uniform_init": f"WITH {of_vectors('c', 1, f'(1::DOUBLE / {K})')} " + cells("c", "vec", "code"),
    "vq_distance": f"WITH {TOK}, {CB1} SELECT tok, code, round({sq('z', 'vec')}, 6) AS dist FROM tok, cb1",
    "vq_assign": f"{ASSIGNED} SELECT tok, code, round(dist, 6) AS dist FROM a",
    "vq_dequantize": f"{ASSIGNED} " + cells("a", "vec", "tok"),
    "vq_loss": f"{ASSIGNED}, m AS (SELECT sum(dist) / (count(*) * {DIM}) AS mse FROM a) SELECT round(mse * 0.25::DOUBLE, 6) AS commitment, round(mse, 6) AS codebook, round(mse * 1.25::DOUBLE, 6) AS total FROM m",
    "vq_histogram": f"{ASSIGNED}, {full_batches('a')} SELECT batch_id, code, count(*) AS n FROM bt GROUP BY ALL",
    "vq_stats_batch_mean": f"{ASSIGNED}, {full_batches('a')}, {code_stats('bt', 'batch_id', str(K))} SELECT {MEANS} FROM per",
    "vq_stats_global": f"{ASSIGNED}, {code_stats('a', '', str(K))} SELECT {PLAIN} FROM per",
    "rvq_encode": f"{encoded()} SELECT tok, c1, round(d1, 6) AS d1, c2, round(d2, 6) AS d2 FROM enc",
    "rvq_mixed_k": f"{encoded(8)} SELECT tok, c1, round(d1, 6) AS d1, c2, round(d2, 6) AS d2 FROM enc",
    "rvq_decode": f"{encoded()} " + cells("enc", "y", "tok"),
    "rvq_decode_prefix": f"{encoded()} " + cells("enc", "v1", "tok"),
    "rvq_level_loss": f"{encoded()}, m AS (SELECT level, sum(dist) / (count(*) * {DIM}) AS mse FROM lev GROUP BY level) SELECT level, round(mse * 0.25::DOUBLE, 6) AS commitment, round(mse, 6) AS codebook, round(mse * 1.25::DOUBLE, 6) AS total FROM m",
    "rvq_level_stats": f"{encoded(8)}, {full_batches('(SELECT * FROM lev)', 'b0').replace(f'PARTITION BY tok // {BATCH}', f'PARTITION BY level, tok // {BATCH}')}, {code_stats('b0', 'level, batch_id', SIZE)} SELECT level, {MEANS} FROM per GROUP BY level",
    "rvq_summary_stats": f"{encoded(8)}, {full_batches('(SELECT * FROM lev)', 'b0').replace(f'PARTITION BY tok // {BATCH}', f'PARTITION BY level, tok // {BATCH}')}, {code_stats('b0', 'level, batch_id', SIZE)}, l AS (SELECT level, avg(entropy_bits) AS entropy_bits, avg(perplexity) AS perplexity, avg(usage) AS usage FROM per GROUP BY level) SELECT round(sum(entropy_bits), 6) AS entropy_bits, round(avg(perplexity), 6) AS perplexity, round(avg(usage), 6) AS usage FROM l",
    "gs_weights": f"WITH {of_vectors('proj', 11, '0.25::DOUBLE')}, {of_vectors('emb', 12, f'(1::DOUBLE / {GK})')}, w AS (SELECT 'projection' AS name, * FROM proj UNION ALL SELECT 'embedding', * FROM emb) " + cells("w", "vec", "name", "code"),
    "gs_logits": f"WITH {SCORED} " + TOK_CELL.format("l", "sc"),
    "gs_logits_passthrough": f"WITH {TOK}, d AS (SELECT tok, (i - 1)::INT AS code, z[i] AS l FROM tok, (SELECT unnest(range(1, {GK + 1})) AS i)), {softmax('l / 0.5::DOUBLE', 'd')} " + TOK_CELL.format("p", "p"),
    "gs_softmax": f"{SOFT} " + TOK_CELL.format("p", "p"),
    "gs_gumbel_noise": f"WITH {TOK} SELECT tok, code AS dim, round({NOISE}, 6) AS v FROM tok, (SELECT unnest(range({GK}))::INT AS code)",
    "gs_gumbel_softmax": f"WITH {SCORED}, {softmax(f'(l + ({NOISE})) / {TAU}::DOUBLE')} " + TOK_CELL.format("p", "p"),
    "gs_index": f"{SOFT}, {TOP} SELECT tok, code FROM top",
    "gs_expected_embedding": f"{SOFT} SELECT tok, (i - 1)::INT AS dim, round(sum(p * vec[i]), 6) AS v FROM p JOIN emb USING (code), (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY tok, i",
    "gs_hard_embedding": f"{SOFT}, {TOP}, w AS (SELECT tok, vec FROM top JOIN emb USING (code)) " + cells("w", "vec", "tok"),
    "gs_token_entropy": f"{SOFT}, {NATS} SELECT tok, round(nats, 6) AS nats FROM nats",
    "gs_kl_bits": f"{SOFT}, {NATS}, {full_batches('nats', 'bn')}, {KL} SELECT batch_id, round(kl_bits, 6) AS kl_bits FROM kl",
    "gs_kl_loss": f"{SOFT}, {NATS}, {full_batches('nats', 'bn')}, {KL} SELECT batch_id, round(0.25::DOUBLE * kl_bits, 6) AS kl_loss FROM kl",
    "gs_stats": f"{SOFT}, {NATS}, {TOP}, {full_batches('nats', 'bn')}, {KL}, {full_batches('top', 'bt')}, {code_stats('bt', 'batch_id', str(GK))} SELECT (SELECT round(avg(kl_bits), 6) FROM kl) AS bits, round(avg(perplexity), 6) AS perplexity, round(avg(usage), 6) AS usage, {TAU}::DOUBLE AS temperature FROM per",
    "recon_mse": recon(MSE),
    "recon_cosine": recon(COSINE),
    "recon_d_loss": recon(D_LOSS),
    "recon_prd_percent": recon(f"100 * sqrt({MSE})"),
    "recon_prd_normalised": recon(f"100 * sqrt(sum({sq('x', 'y')}) / sum({DOT('x', 'x')}))"),
    "recon_weighted_mse": recon(f"sum((tok % 5 + 1)::DOUBLE * {sq('x', 'y')} / {DIM}) / sum((tok % 5 + 1)::DOUBLE)"),
    "total_loss": f"{encoded()}, t AS (SELECT {MSE} AS recon, {D_LOSS} AS extra, (sum(d1) + sum(d2)) / (count(*) * {DIM}) * 1.25::DOUBLE AS layer FROM enc) SELECT round(recon, 6) AS recon, round(extra, 6) AS extra, round(layer, 6) AS layer, round(recon + extra + layer, 6) AS loss FROM t",
    "train_metrics": f"{encoded()}, t AS (SELECT {MSE} AS mse, {COSINE} AS cosine, 100 * sqrt({MSE}) AS prd FROM enc) SELECT 'mse' AS metric, round(mse, 6) AS value FROM t UNION ALL SELECT 'cosine', round(cosine, 6) FROM t UNION ALL SELECT 'prd', round(prd, 6) FROM t",
    "stream_metrics": f"""{encoded(8)}, ep AS (SELECT enc.*, label::BIGINT AS epoch, enc.tok // {BATCH} AS batch_id FROM enc JOIN embeddings ON vec_id = enc.tok // 4),
        ml AS (SELECT level, code, epoch, batch_id FROM lev JOIN ep USING (tok)), {code_stats('ml', 'epoch, level, batch_id', SIZE)},
        mn AS (SELECT epoch, level, avg(entropy_bits) AS eb, avg(perplexity) AS pp, avg(usage) AS us FROM per GROUP BY epoch, level)
        SELECT epoch, 'mse' AS metric, 0 AS level, round({MSE}, 6) AS value FROM ep GROUP BY epoch UNION ALL SELECT epoch, 'cosine', 0, round({COSINE}, 6) FROM ep GROUP BY epoch
        UNION ALL SELECT epoch, 'entropy_bits', level, round(eb, 6) + 0 FROM mn UNION ALL SELECT epoch, 'perplexity', level, round(pp, 6) FROM mn UNION ALL SELECT epoch, 'usage', level, round(us, 6) FROM mn""",
    "rate_report": f"{encoded()}, {code_stats('lev', 'level', str(K))} SELECT level, round(entropy_bits, 6) AS entropy_bits, 32::DOUBLE AS bits_per_frame, 250::DOUBLE AS bits_per_second, 32::DOUBLE AS ratio FROM per",
    "contrastive_loss": f"""WITH {TOK}, q AS (SELECT tok, z, list_transform(range(1, {DIM + 1}), lambda i: z[i] + 0.01::DOUBLE * (i - 1)) AS w FROM tok),
        v AS (SELECT tok // 32 AS b, tok, 0 AS side, z AS v FROM q UNION ALL SELECT tok // 32, tok, 1, w FROM q),
        o AS (SELECT l.tok, l.side, l.tok = r.tok AS mate, {DOT('l.v', 'r.v')} / (sqrt({DOT('l.v', 'l.v')}) * sqrt({DOT('r.v', 'r.v')})) / 0.1::DOUBLE AS s FROM v l JOIN v r ON l.b = r.b AND NOT (l.tok = r.tok AND l.side = r.side)),
        e AS (SELECT tok, side, ln(sum(exp(s))) - max(CASE WHEN mate THEN s END) AS loss FROM o GROUP BY tok, side) SELECT round(avg(loss), 6) AS loss FROM e""",
    "temp_anneal_cosine": anneal("cosine"),
    "temp_anneal_exp": anneal("exp"),
    "lr_cosine_decay": f"WITH {TOK} SELECT tok AS step, round(0.0005::DOUBLE * (1 + cos(pi() * (least(tok, 1500) / 1500::DOUBLE))), 9) AS rate FROM tok",
    "early_stopping": f"""WITH {FRAMES}, {HISTORY}, m AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hist),
        l AS (SELECT *, max(CASE WHEN before IS NULL OR val_loss < before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS lb FROM m),
        st AS (SELECT run, min(CASE WHEN epoch - lb >= 12 THEN epoch END) AS stop_epoch FROM l GROUP BY run)
        SELECT run, arg_min(epoch, (val_loss, epoch)) AS best_epoch, round(min(val_loss), 6) AS best_loss, any_value(stop_epoch) AS stop_epoch FROM hist JOIN st USING (run) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run""",
    "checkpoint_epochs": f"WITH {FRAMES}, {HISTORY}, m AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hist) SELECT run, epoch, round(val_loss, 6) AS val_loss FROM m WHERE before IS NULL OR val_loss < before",
    "best_checkpoint": f"WITH {FRAMES}, {HISTORY} SELECT run, arg_min(epoch, (val_loss, epoch)) AS epoch, round(min(val_loss), 6) AS val_loss FROM hist GROUP BY run",
    "codebook_grad": f"{GRAD} SELECT code, dim, round(grad, 9) AS grad FROM g",
    "codebook_sgd_step": f"{GRAD} SELECT code, dim, round(e - 5::DOUBLE * grad, 6) AS v FROM g",
    "codebook_adam_step": f"{GRAD} SELECT code, dim, round(e - {1e-3 * (1 - 0.999) ** 0.5 / (1 - 0.9)!r}::DOUBLE * (grad * {1 - 0.9!r}::DOUBLE) / (sqrt(grad * grad * {1 - 0.999!r}::DOUBLE) + 1e-7::DOUBLE), 6) AS e, round(grad * {1 - 0.9!r}::DOUBLE, 9) AS m FROM g",
    "codebook_neighbours": f"WITH {TOK}, {CB1}, d AS (SELECT a.code, b.code AS other, {sq('a.vec', 'b.vec')} AS dist FROM cb1 a, cb1 b WHERE a.code <> b.code) SELECT code, arg_min(other, (dist, other)) AS other, round(min(dist), 6) AS dist FROM d GROUP BY code",
    "conv1d_same_stride2": frame_cells(conv(TAPS, 2, 2), FRAME // 2),
    "channel_layernorm": f"WITH {TOK}, y AS (SELECT tok, {norm('z', str(DIM), '1e-5')} AS x FROM tok) " + cells("y", "x", "tok"),
    "upsample_nearest": frame_cells(f"list_transform(range({2 * FRAME}), lambda i: samples[i // 2 + 1])", 2 * FRAME),
    "separable_conv": frame_cells("flatten(list_transform(" + conv(DEEP, 1, 2) + ", lambda v: [" + ", ".join(f"v * {p}::DOUBLE" for p in POINT) + "]))", 3 * FRAME),
}
ORACLE_SQL["contrastive_loss_all"] = ORACLE_SQL["contrastive_loss"]

# ------------------------------------------------------------------ joint gradients

RVQ_GRAD = f"""{encoded(8)}, n AS (SELECT count(*) AS n_all FROM enc), d AS (SELECT unnest(range(1, {DIM + 1})) AS i),
    u AS (SELECT 1 AS level, c1 AS code, i - 1 AS dim, sum(x[i]) AS s, count(*) AS n FROM enc, d GROUP BY ALL UNION ALL SELECT 2, c2, i - 1, sum(x[i] - v1[i]), count(*) FROM enc, d GROUP BY ALL),
    c AS (SELECT 1 AS level, code, i - 1 AS dim, vec[i] AS e FROM cb1, d UNION ALL SELECT 2, code, i - 1, vec[i] FROM cb2, d),
    g AS (SELECT level, code, dim::INT AS dim, e, 2::DOUBLE / (n_all * {DIM}) * (coalesce(n, 0) * e - coalesce(s, 0)) AS grad FROM c LEFT JOIN u USING (level, code, dim), n)"""
ORACLE_SQL |= {
    "rvq_joint_grad": f"{RVQ_GRAD} SELECT level, code, dim, round(grad, 9) + 0 AS grad FROM g",
    "rvq_joint_adam_step": f"{RVQ_GRAD} SELECT level, code, dim, round(e - {1e-3 * (1 - 0.999) ** 0.5 / (1 - 0.9)!r}::DOUBLE * (grad * {1 - 0.9!r}::DOUBLE) / (sqrt(grad * grad * {1 - 0.999!r}::DOUBLE) + 1e-7::DOUBLE), 6) + 0 AS e, round(grad * {1 - 0.9!r}::DOUBLE, 9) + 0 AS m FROM g",
    "gs_joint_grad": f"""{SOFT}, d AS (SELECT unnest(range(1, {DIM + 1})) AS i), n AS (SELECT count(*) AS n FROM tok),
    yv AS (SELECT tok, i, sum(p * vec[i]) AS y FROM p JOIN emb USING (code), d GROUP BY tok, i),
    gy AS (SELECT tok, i, 2::DOUBLE / {DIM} * (y - z[i]) AS g, z[i] AS zi FROM yv JOIN tok USING (tok)),
    gp AS (SELECT tok, code, p, 0.25::DOUBLE / {LN2} * (ln(p + {EPS}) + p / (p + {EPS})) + sum(g * vec[i]) AS gp FROM p JOIN emb USING (code) JOIN gy USING (tok) GROUP BY tok, code, p),
    gl AS (SELECT *, p * (gp - sum(p * gp) OVER (PARTITION BY tok)) / {TAU}::DOUBLE AS gl FROM gp),
    a AS (SELECT code, i, sum(p * g) AS e, sum(gl * zi) AS w FROM gl JOIN gy USING (tok) GROUP BY code, i)
    SELECT 'embedding' AS name, code, (i - 1)::INT AS dim, round(e / n, 9) + 0 AS grad FROM a, n UNION ALL SELECT 'projection', code, (i - 1)::INT, round(w / n, 9) + 0 FROM a, n
    UNION ALL SELECT 'bias', code, 0, round(sum(gl) / any_value(n), 9) + 0 FROM gl, n GROUP BY code""",
}

# ------------------------------------------------------------------ neural blocks: rows (id, p, c, v) of a sample's channel

ERF = "CASE WHEN abs({0}) >= 6 THEN sign({0}) ELSE exp(-({0}) * ({0})) * list_sum(list_transform(range(121), lambda n: pow({0}, 2 * n + 1) / gamma(n + 1.5::DOUBLE))) END"
HALF = "(v / sqrt(2::DOUBLE))"
GELU = f"v * 0.5::DOUBLE * (1 + {ERF.format(HALF)})"
#: (user_id, frame) as one number.
ID = "user_id * 1000000 + frame"


def literal(values: np.ndarray) -> str:
    return "'[" + ", ".join(repr(float(v)) for v in np.ravel(values)) + "]'::DOUBLE[]"


def sql_conv(out: str, source: str, kernel: np.ndarray, bias: np.ndarray, stride: int, length: int, each: bool = False) -> str:
    """each: a kernel (width, channels) for every channel alone."""
    width, channels = kernel.shape[:2]
    after = channels if each else kernel.shape[2]
    left = nn.same_padding(length, width, stride)[0]
    place = f"(s.p + {left} - k.t)"
    where = f"{place} >= 0 AND {place} % {stride} = 0 AND {place} // {stride} < {-(-length // stride)}"
    of = "i % " + str(channels) if each else f"i // {after} % {channels}"
    return f"""{out}_k AS (SELECT i // {channels * (1 if each else after)} AS t, {of} AS c, i % {after} AS o, w FROM (SELECT unnest(range({kernel.size})) AS i, unnest({literal(kernel)}) AS w)),
    {out} AS (SELECT s.id, {place} // {stride} AS p, k.o AS c, sum(s.v * k.w) + any_value(({literal(bias)})[k.o + 1]) AS v FROM {source} s JOIN {out}_k k ON s.c = k.c WHERE {where} GROUP BY 1, 2, 3)"""


def sql_norm(out: str, source: str, gain: np.ndarray, shift: np.ndarray) -> str:
    return f"""{out}_m AS (SELECT *, v - avg(v) OVER (PARTITION BY id, p) AS d FROM {source}),
    {out} AS (SELECT id, p, c, d / sqrt(avg(d * d) OVER (PARTITION BY id, p) + 1e-5::DOUBLE) * ({literal(gain)})[c + 1] + ({literal(shift)})[c + 1] AS v FROM {out}_m)"""


def sql_gelu(out: str, source: str) -> str:
    return f"{out} AS (SELECT id, p, c, {GELU} AS v FROM {source})"


def sql_down(out: str, source: str, w: nn.Weights, name: str, length: int) -> str:
    return ",\n".join([sql_conv(f"{out}c", source, w[name], w[name + ".b"], 2, length), sql_norm(f"{out}n", f"{out}c", w[name + ".n.g"], w[name + ".n.s"]), sql_gelu(out, f"{out}n")])


def sql_up(out: str, source: str, w: nn.Weights, name: str, length: int) -> str:
    wide = f"{out}u AS (SELECT id, p * 2 + u AS p, c, v FROM {source}, (SELECT unnest([0, 1]) AS u))"
    depth = w[name + ".d"]
    return ",\n".join([
        wide, sql_conv(f"{out}c", f"{out}u", w[name], w[name + ".b"], 1, 2 * length), sql_gelu(f"{out}g", f"{out}c"),
        sql_conv(f"{out}d", f"{out}g", depth, np.zeros(depth.shape[1]), 1, 2 * length, each=True), sql_conv(out, f"{out}d", w[name + ".p"][None], w[name + ".p.b"], 1, 2 * length),
    ])


def sql_encode(source: str, w: nn.Weights, length: int) -> str:
    """z from source."""
    steps = [sql_down(f"e{i}", source if i == 1 else f"e{i - 1}", w, f"down{i}", length >> i - 1) for i in range(1, 5)]
    return ",\n".join([*steps, sql_conv("z", "e4", w["latent"], w["latent.b"], 1, length >> 4)])


def sql_decode(source: str, w: nn.Weights, tokens: int) -> str:
    """out from source."""
    steps = [sql_up(f"d{i}", source if i == 4 else f"d{i + 1}", w, f"up{i}", tokens << 4 - i) for i in range(4, 0, -1)]
    return ",\n".join([*steps, sql_norm("dn", "d1", w["out.n.g"], w["out.n.s"]), sql_conv('"out"', "dn", w["out"], w["out.b"], 1, tokens << 4).replace('"out"_k', "out_k")])


NORM_FRAMES = f"""{FRAMES}, nf AS (SELECT {ID} AS id, user_id, frame, {norm('samples', str(FRAME), '0.001')} AS x FROM ff),
    xs AS (SELECT id, i - 1 AS p, 0 AS c, x[i] AS v FROM nf, (SELECT unnest(range(1, {FRAME + 1})) AS i))"""
SMALL, LOGITS = nn.Weights.draw(base=4, dim=DIM, seed=SEED), nn.Weights.draw(base=4, dim=GK, out=DIM, seed=SEED)


def sql_level(out: str, source: str, k: int, level: int) -> str:
    """{out}: what is left of source after its nearest codewords, {out}_q: these."""
    return f"""{init(out + '_b', k, level, '1::DOUBLE')}, {out}_d AS (SELECT id, p, code, sum((v - vec[c + 1]) * (v - vec[c + 1])) AS dist FROM {source}, {out}_b GROUP BY id, p, code),
    {out}_n AS (SELECT id, p, arg_min(code, (dist, code)) AS code FROM {out}_d GROUP BY id, p),
    {out}_q AS (SELECT s.id, s.p, s.c, vec[s.c + 1] AS v FROM {source} s JOIN {out}_n USING (id, p) JOIN {out}_b USING (code)),
    {out} AS (SELECT s.id, s.p, s.c, s.v - q.v AS v FROM {source} s JOIN {out}_q q USING (id, p, c))"""


def sql_gumbel(logits: str, noise: str = "0") -> str:
    """y from logits (id, p, code, l)."""
    return f"""lt AS (SELECT id, p, code, (l + {noise}) / {TAU}::DOUBLE AS l FROM {logits}), lm AS (SELECT *, max(l) OVER (PARTITION BY id, p) AS top FROM lt),
    ps AS (SELECT id, p, code, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id, p) AS w FROM lm),
    y AS (SELECT id, p, c, sum(w * vec[c + 1]) AS v FROM ps JOIN emb USING (code), (SELECT unnest(range({DIM})) AS c) GROUP BY id, p, c)"""


ROUND_TRIP = """SELECT (a.id // 1000000) AS user_id, (a.id % 1000000)::INT AS frame, round(sum((a.v - b.v) * (a.v - b.v)) / count(*), 6) AS mse,
    round(CASE WHEN sum(a.v * a.v) > 0 AND sum(b.v * b.v) > 0 THEN sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) ELSE 0 END, 6) + 0 AS cosine
    FROM xs a JOIN "out" b USING (id, p) GROUP BY a.id"""
CHANNELS = "SELECT (id // 1000000) AS user_id, (id % 1000000)::INT AS frame, p::INT AS pos, c::INT AS dim, round(v, 6) + 0 AS v FROM {}"
VECTORS = f"vs AS (SELECT vec_id AS id, i // {DIM} AS p, i % {DIM} AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range({4 * DIM})) AS i))"
GS_NOISE = NOISE.replace(uniform("7", "tok", "code"), uniform("7", "id // 1000000", "id % 1000000", "p", "code"))
ORACLE_SQL |= {
    "gelu": f"SELECT event_id, round({GELU}, 6) + 0 AS y FROM (SELECT event_id, value / 100 - 1 AS v FROM events)",
    "encoder_block": f"WITH {NORM_FRAMES}, {sql_down('e1', 'xs', SMALL, 'down1', FRAME)} " + CHANNELS.format("e1"),
    "decoder_block": f"WITH {VECTORS}, {sql_up('d4', 'vs', SMALL, 'up4', 4)} SELECT id AS vec_id, p::INT AS pos, c::INT AS dim, round(v, 6) + 0 AS v FROM d4",
    "encoder_16x": f"WITH {NORM_FRAMES}, {sql_encode('xs', SMALL, FRAME)} " + CHANNELS.format("z"),
    "decoder_16x": f"WITH {VECTORS}, {sql_decode('vs', SMALL, 4)} SELECT id AS vec_id, p::INT AS dim, round(v, 6) + 0 AS v FROM \"out\"",
    "codec_roundtrip": f"""WITH {NORM_FRAMES}, {sql_encode('xs', SMALL, FRAME)}, {sql_level('r1', 'z', K, 1)}, {sql_level('r2', 'r1', 8, 2)},
        y AS (SELECT a.id, a.p, a.c, a.v + b.v AS v FROM r1_q a JOIN r2_q b USING (id, p, c)), {sql_decode('y', SMALL, FRAME // 16)} {ROUND_TRIP}""",
    "gs_codec_roundtrip": f"""WITH {NORM_FRAMES}, {PROJ}, {EMB}, {sql_encode('xs', SMALL, FRAME)},
        lg AS (SELECT id, p, code, sum(v * vec[c + 1]) + any_value({BIAS}) AS l FROM z, proj GROUP BY id, p, code), {sql_gumbel('lg', GS_NOISE)}, {sql_decode('y', SMALL, FRAME // 16)} {ROUND_TRIP}""",
    "gs_codec_logits": f"""WITH {NORM_FRAMES}, {EMB}, {sql_encode('xs', LOGITS, FRAME)}, lg AS (SELECT id, p, c::INT AS code, v AS l FROM z), {sql_gumbel('lg')}, {sql_decode('y', LOGITS, FRAME // 16)} {ROUND_TRIP}""",
}
