"""Queries of the tensor functions: a dense matrix of embeddings and a sparse supplier-part tensor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import tensor as t
from .inputs import table

_E = "e AS (SELECT vec_id AS i0, unnest(range(64)) AS i1, unnest(embedding::DOUBLE[]) AS v FROM embeddings)"
_N = "(SELECT max(vec_id) + 1 FROM embeddings)"
_S = "s AS (SELECT l_suppkey AS i0, l_partkey AS i1, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey AS i0, l_partkey AS i1, sum(l_linenumber)::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"


def dense(spark, d):
    """All embeddings as a matrix; ids have no gaps."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    e = e.select(F.col("vec_id").alias("i0"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i1", "v"))
    return t.Tensor(e.select("i0", F.col("i1").cast("long").alias("i1"), "v"), (n, 64), True)


def sparse(spark, d, returned=False):
    l = table(spark, d, "lineitem")
    shape = (table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1, table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1)
    if returned:
        return t.Tensor.from_columns(l.where("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"], "l_linenumber", shape)
    return t.Tensor.from_columns(l, ["l_suppkey", "l_partkey"], "l_quantity", shape)


def _through_numpy(x: t.Tensor) -> t.Tensor:
    """To numpy arrays and back, block by block: no process holds the whole array."""
    return t.Tensor.from_blocks(x.to_blocks(), x.shape, x.dense)


def _rounded(x: t.Tensor):
    return x.df.select(*x.idx, F.round("v", 6).alias("v"))


_ELEMENTWISE = {
    "exp": "exp(v)", "expm1": "exp(v) - 1", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "sinh": "(exp(v) - exp(-v)) / 2", "cosh": "(exp(v) + exp(-v)) / 2", "tanh": "(exp(v) - exp(-v)) / (exp(v) + exp(-v))",
    "square": "v * v", "ceil": "ceil(v)", "floor": "floor(v)", "trunc": "trunc(v)", "sign": "sign(v)", "reciprocal": "1 / v",
}
for _name, _sql in _ELEMENTWISE.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, i1, round({_sql}, 6)::DOUBLE + 0 AS v FROM e")(lambda spark, d, f=getattr(t, _name): dense_value(f(dense(spark, d))))


def dense_value(x: t.Tensor):
    return x.df.select(*x.idx, (F.round(F.col("v").cast("double"), 6) + 0).alias("v"))


for _name, _sql in {"log": "ln(abs(v))", "log2": "log2(abs(v))", "log10": "log10(abs(v))", "log1p": "ln(1 + abs(v))", "sqrt": "sqrt(abs(v))"}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, i1, round({_sql}, 6) + 0 AS v FROM e")(lambda spark, d, f=getattr(t, _name): dense_value(f(abs(dense(spark, d)))))

for _name, _sql in {"isnan": "isnan(v)", "isinf": "isinf(v)", "isfinite": "isfinite(v)"}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, i1, {_sql} AS v FROM e")(lambda spark, d, f=getattr(t, _name): f(dense(spark, d)).df)

for _name, _sql in {"sum": "sum(v)", "mean": "avg(v)", "var": "var_pop(v)", "std": "stddev_pop(v)"}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i1 AS i0, round({_sql}, 6) + 0 AS v FROM e GROUP BY 1")(lambda spark, d, f=getattr(t, _name): dense_value(f(dense(spark, d), 0)))
query("tensor_prod", f"WITH {_E} SELECT i0, round(product(1 + v), 6) + 0 AS v FROM e GROUP BY 1")(lambda spark, d: dense_value(t.prod(dense(spark, d) + 1, 1)))
for _name, _sql in {"amax": "max(v)", "amin": "min(v)", "median": "quantile_cont(v, 0.5)", "argmax": "arg_max(i1, v)", "argmin": "arg_min(i1, v)"}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, round({_sql}, 6)::DOUBLE + 0 AS v FROM e GROUP BY 1")(lambda spark, d, f=getattr(t, _name): dense_value(f(dense(spark, d), 1)))
query("tensor_all", f"WITH {_E} SELECT i0, bool_and(v > -0.2) AS v FROM e GROUP BY 1")(lambda spark, d: t.all(dense(spark, d) > -0.2, 1).df)
query("tensor_any", f"WITH {_E} SELECT i0, bool_or(v > 0.3) AS v FROM e GROUP BY 1")(lambda spark, d: t.any(dense(spark, d) > 0.3, 1).df)

_BOTH = "SELECT coalesce(s.i0, o.i0) AS i0, coalesce(s.i1, o.i1) AS i1, coalesce(s.v, 0) AS a, coalesce(o.v, 0) AS b FROM s FULL JOIN o ON s.i0 = o.i0 AND s.i1 = o.i1"
for _name, _sql in {"add": "a + b", "subtract": "a - b"}.items():
    query(f"tensor_{_name}", f"WITH {_S}, j AS ({_BOTH}) SELECT i0, i1, {_sql} AS v FROM j")(lambda spark, d, f=getattr(t, _name): f(sparse(spark, d), sparse(spark, d, True)).df)
query("tensor_multiply", f"WITH {_S} SELECT s.i0, s.i1, s.v * o.v AS v FROM s JOIN o ON s.i0 = o.i0 AND s.i1 = o.i1")(lambda spark, d: t.multiply(sparse(spark, d), sparse(spark, d, True)).df)
for _name, _sql in {"bitwise_and": "a::BIGINT & b::BIGINT", "bitwise_or": "a::BIGINT | b::BIGINT", "bitwise_xor": "xor(a::BIGINT, b::BIGINT)"}.items():
    _where = " WHERE a <> 0 AND b <> 0" if _name == "bitwise_and" else ""
    query(f"tensor_{_name}", f"WITH {_S}, j AS ({_BOTH}) SELECT i0, i1, {_sql} AS v FROM j{_where}")(lambda spark, d, f=getattr(t, _name): f(sparse(spark, d), sparse(spark, d, True)).df)

for _name, _sql in {"true_divide": "v / 0.3::DOUBLE", "floor_divide": "floor(v / 0.3::DOUBLE)", "remainder": "v - 0.3::DOUBLE * floor(v / 0.3::DOUBLE)", "fmod": "v - 0.3::DOUBLE * trunc(v / 0.3::DOUBLE)"}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, i1, round({_sql}, 6) + 0 AS v FROM e")(lambda spark, d, f=getattr(t, _name): dense_value(f(dense(spark, d), 0.3)))
query("tensor_equal", f"WITH {_E} SELECT i0, i1, v > 0 AS v FROM e")(lambda spark, d: t.equal(t.sign(dense(spark, d)), 1.0).df)
for _name, _sql in {"logical_and": "v > 0 AND v > 0.1", "logical_or": "v > 0 OR v > 0.1", "logical_xor": "(v > 0) <> (v > 0.1)"}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, i1, {_sql} AS v FROM e")(lambda spark, d, f=getattr(t, _name): f(dense(spark, d) > 0, dense(spark, d) > 0.1).df)
query("tensor_logical_not", f"WITH {_E} SELECT i0, i1, NOT (v > 0) AS v FROM e")(lambda spark, d: t.logical_not(dense(spark, d) > 0).df)
query("tensor_bitwise_not", f"WITH {_E} SELECT i0, i1, -CAST(floor(v * 100) AS BIGINT) - 1 AS v FROM e")(lambda spark, d: t.bitwise_not(t.floor(dense(spark, d) * 100)).df)
query("tensor_where", f"WITH {_E} SELECT i0, i1, CASE WHEN v > 0 THEN v ELSE 0.5::DOUBLE END AS v FROM e")(lambda spark, d: t.where(dense(spark, d) > 0, dense(spark, d), 0.5).df)

query("tensor_dot", f"WITH {_E} SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 6) + 0 AS v FROM e a JOIN e b ON a.i0 = b.i0 GROUP BY ALL")(lambda spark, d: dense_value(t.dot(t.transpose(dense(spark, d)), dense(spark, d))))
query("tensor_matmul", f"WITH {_S} SELECT s.i0, o.i0 AS i1, sum(s.v * o.v) AS v FROM s JOIN o ON s.i1 = o.i1 GROUP BY ALL")(lambda spark, d: t.matmul(sparse(spark, d), t.transpose(sparse(spark, d, True))).df)
query("tensor_tensordot", f"WITH {_S} SELECT coalesce(sum(s.v * o.v), 0) AS v FROM s JOIN o ON s.i0 = o.i0 AND s.i1 = o.i1")(lambda spark, d: t.tensordot(sparse(spark, d), sparse(spark, d, True)).df)
query("tensor_trace", f"WITH {_S} SELECT coalesce(sum(v), 0) AS v FROM s WHERE i0 = i1")(lambda spark, d: t.trace(sparse(spark, d)).df)
query("tensor_diagonal", f"WITH {_S} SELECT i0, v FROM s WHERE i1 = i0 + 3")(lambda spark, d: t.diagonal(sparse(spark, d), 3).df)
query("tensor_tril", f"WITH {_S} SELECT * FROM s WHERE i1 <= i0 + 2")(lambda spark, d: t.tril(sparse(spark, d), 2).df)
query("tensor_triu", f"WITH {_S} SELECT * FROM s WHERE i1 >= i0 + 2")(lambda spark, d: t.triu(sparse(spark, d), 2).df)
query("tensor_transpose", f"WITH {_S} SELECT i1 AS i0, i0 AS i1, v FROM s")(lambda spark, d: t.transpose(sparse(spark, d)).df)
query("tensor_reshape", f"WITH {_E} SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, v FROM e")(lambda spark, d: t.reshape(dense(spark, d), (-1, 32)).df)
query("tensor_flip", f"WITH {_E} SELECT {_N} - 1 - i0 AS i0, 63 - i1 AS i1, v FROM e")(lambda spark, d: t.flip(dense(spark, d)).df)
query("tensor_roll", f"WITH {_E} SELECT i0, (i1 + 5) % 64 AS i1, v FROM e")(lambda spark, d: t.roll(dense(spark, d), 5, 1).df)
query("tensor_rot90", f"WITH {_E} SELECT 63 - i1 AS i0, i0 AS i1, v FROM e")(lambda spark, d: t.rot90(dense(spark, d)).df)
query("tensor_concatenate", f"WITH {_E} SELECT * FROM e UNION ALL SELECT i0 + {_N}, i1, v FROM e")(lambda spark, d: t.concatenate([dense(spark, d), dense(spark, d)]).df)
query("tensor_stack", f"WITH {_E} SELECT 0::BIGINT AS i0, i0 AS i1, i1 AS i2, v FROM e UNION ALL SELECT 1, i0, i1, v FROM e")(lambda spark, d: t.stack([dense(spark, d), dense(spark, d)]).df)
query("tensor_split", f"WITH {_E} SELECT i0, i1 - 32 AS i1, v FROM e WHERE i1 >= 32")(lambda spark, d: t.split(dense(spark, d), 2, 1)[1].df)
query("tensor_squeeze", f"WITH {_E} SELECT i0 * 64 + i1 AS i0, v FROM e")(lambda spark, d: t.squeeze(t.reshape(dense(spark, d), (1, -1))).df)
query("tensor_take", f"WITH {_E} SELECT list_position([70, 3, 1000], i0 * 64 + i1) - 1 AS i0, v FROM e WHERE i0 * 64 + i1 IN (70, 3, 1000)")(lambda spark, d: t.take(dense(spark, d), [70, 3, 1000]).df)
query("tensor_getitem", f"WITH {_E} SELECT i0 - 4 AS i0, i1 // 2 AS i1, v FROM e WHERE i0 >= 4 AND i0 < 9 AND i1 % 2 = 0")(lambda spark, d: dense(spark, d)[4:9, ::2].df)
query("tensor_cumsum", f"WITH {_E} SELECT i0, i1, round(sum(v) OVER (PARTITION BY i0 ORDER BY i1), 6) + 0 AS v FROM e")(lambda spark, d: dense_value(t.cumsum(dense(spark, d), 1)))
query("tensor_cumprod", f"WITH {_E} SELECT i0, i1, round(product(1 + v) OVER (PARTITION BY i0 ORDER BY i1), 6) + 0 AS v FROM e")(lambda spark, d: dense_value(t.cumprod(dense(spark, d) + 1, 1)))
query("tensor_argsort", f"WITH {_E}, k AS (SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS k, i1 FROM e) SELECT i0, k AS i1, i1 AS v FROM k")(lambda spark, d: t.argsort(dense(spark, d), 1).df)
query("tensor_unique", f"WITH {_S} SELECT v, count(*) AS n FROM s GROUP BY v")(lambda spark, d: t.unique(t.Tensor(sparse(spark, d).df, (1, 1), True)))
query("tensor_bincount", f"WITH {_S}, c AS (SELECT CAST(v AS BIGINT) AS value, count(*) AS n FROM s GROUP BY 1) SELECT r AS value, coalesce(n, 0) AS n FROM range((SELECT max(value) + 1 FROM c)) z(r) LEFT JOIN c ON r = value")(lambda spark, d: t.bincount(sparse(spark, d)))
query("tensor_nonzero", f"WITH {_S} SELECT i0, i1 FROM s WHERE v <> 0")(lambda spark, d: t.nonzero(sparse(spark, d)))
query("tensor_diag", f"WITH {_E} SELECT i0, i1 AS i1, v FROM (SELECT i1 AS i0, i1, v FROM e WHERE i0 = 0)")(lambda spark, d: t.diag(dense(spark, d)[0]).df)
query("tensor_eye", "SELECT range AS i0, range AS i1, 1.0::DOUBLE AS v FROM range(7)")(lambda spark, d: t.eye(spark, 7).df)
query("tensor_linspace", "SELECT range AS i0, range * 0.25::DOUBLE AS v FROM range(9)")(lambda spark, d: t.linspace(spark, 0, 2, 9).df)
query("tensor_logspace", "SELECT range AS i0, pow(2.0, range)::DOUBLE AS v FROM range(5)")(lambda spark, d: t.logspace(spark, 0, 4, 5, 2).df)
query("tensor_arange", "SELECT range AS i0, 3 + range * 4 AS v FROM range(6)")(lambda spark, d: t.arange(spark, 3, 27, 4).df)
query("tensor_full", "SELECT a.range AS i0, b.range AS i1, 2.5::DOUBLE AS v FROM range(3) a, range(4) b")(lambda spark, d: t.full(spark, (3, 4), 2.5).df)
query("tensor_tril_indices", "SELECT a.range AS i0, b.range AS i1 FROM range(5) a, range(5) b WHERE b.range <= a.range")(lambda spark, d: t.tril_indices(spark, 5))
query("tensor_meshgrid", "SELECT b.range AS i0, a.range AS i1, a.range AS v FROM range(3) a, range(4) b")(lambda spark, d: t.meshgrid(t.arange(spark, 3), t.arange(spark, 4))[0].df)
query("tensor_triu_indices", "SELECT a.range AS i0, b.range AS i1 FROM range(5) a, range(6) b WHERE b.range >= a.range + 1")(lambda spark, d: t.triu_indices(spark, 5, 1, 6))
query("tensor_diagflat", "SELECT range AS i0, range + 2 AS i1, range::DOUBLE AS v FROM range(6)")(lambda spark, d: t.diagflat(t.reshape(t.arange(spark, 6), (2, 3)), 2).with_value(F.col("v").cast("double")).df)
for _name, _sql in {"zeros": 0, "ones": 1, "empty": 0}.items():
    query(f"tensor_{_name}", f"SELECT a.range AS i0, b.range AS i1, {_sql}::DOUBLE AS v FROM range(4) a, range(3) b")(lambda spark, d, f=getattr(t, _name): f(spark, (4, 3)).df)
for _name, _sql in {"zeros_like": 0, "ones_like": 1, "empty_like": 0}.items():
    query(f"tensor_{_name}", f"WITH {_E} SELECT i0, i1, {_sql}::DOUBLE AS v FROM e")(lambda spark, d, f=getattr(t, _name): f(dense(spark, d)).df)
query("tensor_full_like", f"WITH {_E} SELECT i0, i1, 7.5::DOUBLE AS v FROM e")(lambda spark, d: t.full_like(dense(spark, d), 7.5).df)
query("tensor_astype", f"WITH {_E} SELECT i0, i1, trunc(v * 100)::INT AS v FROM e")(lambda spark, d: (dense(spark, d) * 100).astype("int32").df)
query("tensor_power", f"WITH {_E} SELECT i0, i1, round(pow(v, 3), 6) + 0 AS v FROM e")(lambda spark, d: dense_value(dense(spark, d) ** 3))


def _complex(spark, d):
    """Pairs of neighbouring components as complex cells."""
    x = dense(spark, d)
    even, odd = x[:, ::2], x[:, 1::2].df.withColumnRenamed("v", "w")
    return t.Tensor(even.df.join(odd, even.idx).select(*even.idx, F.struct(F.col("v").alias("re"), F.col("w").alias("im")).alias("v")), even.shape, True)


_C = f"{_E}, c AS (SELECT a.i0, a.i1 // 2 AS i1, a.v AS re, b.v AS im FROM e a JOIN e b ON a.i0 = b.i0 AND b.i1 = a.i1 + 1 WHERE a.i1 % 2 = 0)"
for _name, _sql in {"real": "re", "imag": "im", "angle": "atan2(im, re)"}.items():
    query(f"tensor_{_name}", f"WITH {_C} SELECT i0, i1, round({_sql}, 6) + 0 AS v FROM c")(lambda spark, d, f=getattr(t, _name): dense_value(f(_complex(spark, d))))
query("tensor_conj", f"WITH {_C} SELECT i0, i1, round(-im, 6) + 0 AS v FROM c")(lambda spark, d: dense_value(t.imag(t.conj(_complex(spark, d)))))
query("tensor_to_sparse", f"WITH {_E} SELECT i0, i1, round(greatest(v, 0), 6) + 0 AS v FROM e WHERE v > 0")(lambda spark, d: dense_value(t.where(dense(spark, d) > 0, dense(spark, d), 0.0).to_sparse()))
query("tensor_to_dense", f"WITH {_S}, g AS (SELECT i1, sum(v) AS v FROM s GROUP BY 1) SELECT r AS i0, coalesce(v, 0) AS v FROM range((SELECT max(p_partkey) + 1 FROM part)) z(r) LEFT JOIN g ON r = i1")(lambda spark, d: t.sum(sparse(spark, d), 0).to_dense().df)
query("tensor_from_numpy", f"WITH {_E} SELECT i0, i1, v FROM e")(lambda spark, d: _through_numpy(dense(spark, d)).df)
query("tensor_unique_inverse", f"WITH {_E}, f AS (SELECT i0, i1, floor(v * 100) AS v FROM e) SELECT i0, i1, dense_rank() OVER (ORDER BY v) - 1 AS v FROM f")(lambda spark, d: t.unique_inverse(t.floor(dense(spark, d) * 100)).df)
_FLAT = f"WITH {_E}, f AS (SELECT i0 * 64 + i1 AS i0, v FROM e)"
query("tensor_cumsum_flat", f"{_FLAT} SELECT i0, round(sum(v) OVER (ORDER BY i0), 6) + 0 AS v FROM f")(lambda spark, d: dense_value(t.cumsum(dense(spark, d))))
query("tensor_argsort_flat", f"{_FLAT} SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, i0 AS v FROM f")(lambda spark, d: t.argsort(t.reshape(dense(spark, d), (-1,)), 0).df)
query("tensor_cumprod_flat", f"{_FLAT} SELECT i0, round(product(1 + v / 100) OVER (ORDER BY i0), 6) + 0 AS v FROM f")(lambda spark, d: dense_value(t.cumprod(dense(spark, d) * 0.01 + 1)))
