"""N-mode tensors as long DataFrames: index columns i0..ik-1 (from 0) and a value column v.

A sparse tensor holds non-zero cells only and carries its shape; a dense one holds every cell. Functions keep to these
rules: on sparse input a function that doesn't map 0 to 0 is refused (densify first); reductions count implicit zeros;
sparse and dense tensors don't mix in one call. Everything is a lazy plan of built-in expressions and joins on index
columns; only ``cumprod`` runs a grouped pandas function.
"""

from __future__ import annotations

import builtins
import io
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..tables import cut
from .encode import number, prefix_sums

#: Element types and their Spark counterparts (unsigned bytes and half floats widen).
DTYPES = {"int8": "byte", "uint8": "short", "short": "short", "int16": "short", "int32": "int", "int64": "long", "float16": "float", "float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}
#: Cells of a block of an array that executors hold as one.
BLOCK_CELLS = 1 << 16
_RANK = ["int8", "uint8", "int16", "int32", "int64", "float16", "float32", "float64", "complex64", "complex128"]


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    shape: tuple[int, ...]
    dense: bool = False

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def idx(self) -> list[str]:
        return _idx(self.ndim)

    @property
    def cells(self) -> int:
        return math.prod(self.shape)

    @classmethod
    def from_columns(cls, df: DataFrame, coords: Sequence[str], value: str | None = None, shape: Sequence[int] | None = None) -> Tensor:
        """Coordinates and an optional value (else 1); duplicates are summed. Without a shape: largest index plus one."""
        cols = [F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(coords)]
        v = F.col(value).cast("double") if value else F.lit(1.0)
        long = df.select(*cols, v.alias("v")).groupBy(*_idx(len(coords))).agg(F.sum("v").alias("v"))
        if shape is None:
            row = long.agg(*[F.max(c) for c in _idx(len(coords))]).first()
            shape = [0 if m is None else m + 1 for m in row]
        return cls(long, tuple(shape))

    @classmethod
    def from_numpy(cls, spark: SparkSession, a: np.ndarray, dense: bool = True) -> Tensor:
        a = np.asarray(a)
        at = np.indices(a.shape).reshape(a.ndim, -1) if dense else np.array(np.nonzero(a)).reshape(a.ndim, -1)
        v = a.reshape(-1) if dense else a[np.nonzero(a)]
        pdf = pd.DataFrame({f"i{k}": at[k].astype(np.int64) for k in range(a.ndim)} | {"v": v})
        schema = ", ".join([f"{c} long" for c in _idx(a.ndim)] + ["v boolean" if a.dtype == bool else "v long" if a.dtype.kind in "iu" else "v double"])
        return cls(spark.createDataFrame(pdf, schema), a.shape, dense)

    def to_numpy(self) -> np.ndarray:
        pdf = self.df.toPandas()
        out = np.zeros(self.shape, pdf["v"].dtype if len(pdf) else float)
        out[tuple(pdf[c].to_numpy() for c in self.idx)] = pdf["v"].to_numpy() if self.ndim else pdf["v"].iloc[0]
        return out

    def to_blocks(self) -> DataFrame:
        """(lo, data): the array as .npy bytes of about ``BLOCK_CELLS`` cells, cut along the first mode; made by the executors."""
        n, *rest = self.shape
        step = max(1, BLOCK_CELLS // max(math.prod(rest), 1))
        idx, kind = self.idx, self.df.schema["v"].dataType
        dtype = bool if isinstance(kind, T.BooleanType) else np.int64 if isinstance(kind, T.IntegralType) else float

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            lo = int(pdf["i0"].iloc[0]) // step * step
            a = np.zeros((builtins.min(step, n - lo), *rest), dtype)
            a[(pdf["i0"].to_numpy() - lo, *[pdf[c].to_numpy() for c in idx[1:]])] = pdf["v"].to_numpy()
            out = io.BytesIO()
            np.save(out, a, allow_pickle=False)
            return pd.DataFrame({"lo": [lo], "data": [out.getvalue()]})

        return self.df.groupBy(F.floor(F.col("i0") / step)).applyInPandas(run, "lo long, data binary")

    @classmethod
    def from_blocks(cls, blocks: DataFrame, shape: Sequence[int], dense: bool = True, v: str = "double") -> Tensor:
        """The tensor of blocks as ``to_blocks`` makes them, decoded block by block by the executors; dense ones hold every block."""
        names = _idx(len(shape))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo, data in zip(pdf["lo"], pdf["data"]):
                    a = np.load(io.BytesIO(data), allow_pickle=False)
                    at = np.indices(a.shape).reshape(a.ndim, -1) if dense else np.array(np.nonzero(a)).reshape(a.ndim, -1)
                    yield pd.DataFrame({c: at[k].astype(np.int64) + (lo if k == 0 else 0) for k, c in enumerate(names)} | {"v": a.reshape(-1) if dense else a[tuple(at)]})

        return cls(blocks.mapInPandas(run, ", ".join([f"{c} long" for c in names] + [f"v {v}"])), tuple(shape), dense)

    def astype(self, dtype: str) -> Tensor:
        return self.with_value(F.col("v").cast(DTYPES[dtype]))

    def with_value(self, v: Column) -> Tensor:
        return Tensor(self.df.select(*self.idx, v.alias("v")), self.shape, self.dense)

    def to_dense(self) -> Tensor:
        if self.dense:
            return self
        spark = self.df.sparkSession
        full = grid(spark, self.shape).join(self.df, self.idx, "left") if self.ndim else self.df
        return Tensor(full.select(*self.idx, F.coalesce("v", F.lit(0.0)).alias("v")), self.shape, True)

    def to_sparse(self) -> Tensor:
        return Tensor(self.df.where("v <> 0"), self.shape)

    def __getitem__(self, at) -> Tensor:
        """Integers drop their mode, slices (step 1 or more) keep it, counted from the slice's start."""
        at = at if isinstance(at, tuple) else (at,)
        at = (*at, *[slice(None)] * (self.ndim - len(at)))
        cond, cols, shape = F.lit(True), [], []
        for k, (x, n) in enumerate(zip(at, self.shape)):
            if isinstance(x, slice):
                lo, hi, step = x.indices(n)
                if step < 1:
                    raise ValueError("use flip for negative steps")
                c = F.col(f"i{k}")
                cond = cond & (c >= lo) & (c < hi) & ((c - lo) % step == 0)
                cols.append(F.floor((c - lo) / step).cast("long").alias(f"i{len(shape)}"))
                shape.append(len(range(lo, hi, step)))
            else:
                cond = cond & (F.col(f"i{k}") == (x if x >= 0 else n + x))
        return Tensor(self.df.where(cond).select(*cols, "v"), tuple(shape), self.dense)

    # arithmetic and comparison
    def __add__(self, o): return add(self, o)
    def __radd__(self, o): return add(self, o)
    def __sub__(self, o): return subtract(self, o)
    def __mul__(self, o): return multiply(self, o)
    def __rmul__(self, o): return multiply(self, o)
    def __truediv__(self, o): return true_divide(self, o)
    def __floordiv__(self, o): return floor_divide(self, o)
    def __mod__(self, o): return remainder(self, o)
    def __pow__(self, o): return power(self, o)
    def __neg__(self): return self.with_value(-F.col("v"))
    def __abs__(self): return self.with_value(F.abs("v"))
    def __matmul__(self, o): return matmul(self, o)
    def __gt__(self, o): return _compare(self, o, lambda a, b: a > b)
    def __ge__(self, o): return _compare(self, o, lambda a, b: a >= b)
    def __lt__(self, o): return _compare(self, o, lambda a, b: a < b)
    def __le__(self, o): return _compare(self, o, lambda a, b: a <= b)
    def eq(self, o): return equal(self, o)
    def ne(self, o): return logical_not(equal(self, o))
    def sum(self, axis=None, keepdims=False): return sum(self, axis, keepdims)
    def mean(self, axis=None, keepdims=False): return mean(self, axis, keepdims)
    def max(self, axis=None, keepdims=False): return amax(self, axis, keepdims)
    def min(self, axis=None, keepdims=False): return amin(self, axis, keepdims)
    def prod(self, axis=None, keepdims=False): return prod(self, axis, keepdims)
    def var(self, axis=None, keepdims=False): return var(self, axis, keepdims)
    def std(self, axis=None, keepdims=False): return std(self, axis, keepdims)
    def all(self, axis=None, keepdims=False): return all(self, axis, keepdims)
    def any(self, axis=None, keepdims=False): return any(self, axis, keepdims)
    def dot(self, o): return dot(self, o)
    def reshape(self, shape): return reshape(self, shape)
    def nonzero(self): return nonzero(self)


def _idx(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Every cell's index, from one range of flat positions (no cross join)."""
    n = math.prod(shape)
    flat = spark.range(n)
    return flat.select(*_unravel(F.col("id"), shape)) if shape else flat.select()


def _unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    cols, step = [], math.prod(shape)
    for k, n in enumerate(shape):
        step //= builtins.max(n, 1)
        cols.append((F.floor(flat / F.lit(step)).cast("long") % n if step > 1 else flat % n).alias(f"i{k}"))
    return cols


def _ravel(shape: Sequence[int]) -> Column:
    flat = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        flat = flat * n + F.col(f"i{k}")
    return flat


# ---- elementwise -------------------------------------------------------------------------------------------------

def _unary(name: str, f: Callable[[Column], Column], keeps_zero: bool) -> Callable[[Tensor], Tensor]:
    def g(t: Tensor) -> Tensor:
        if not (t.dense or keeps_zero):
            raise TypeError(f"{name} of a sparse tensor would not be sparse; use to_dense()")
        return t.with_value(f(F.col("v")))

    g.__name__, g.__doc__ = name, f"Elementwise {name}."
    return g


ceil = _unary("ceil", lambda v: F.ceil(v), False)
cos = _unary("cos", F.cos, False)
cosh = _unary("cosh", F.cosh, False)
exp = _unary("exp", F.exp, False)
expm1 = _unary("expm1", F.expm1, True)
floor = _unary("floor", lambda v: F.floor(v), False)
isfinite = _unary("isfinite", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")), False)
isinf = _unary("isinf", lambda v: F.abs(v) == float("inf"), False)
isnan = _unary("isnan", F.isnan, False)
log = _unary("log", F.ln, False)
log10 = _unary("log10", F.log10, False)
log1p = _unary("log1p", F.log1p, True)
log2 = _unary("log2", F.log2, False)
reciprocal = _unary("reciprocal", lambda v: F.try_divide(F.lit(1.0), v), False)
sign = _unary("sign", F.signum, False)
sin = _unary("sin", F.sin, True)
sinh = _unary("sinh", F.sinh, True)
sqrt = _unary("sqrt", F.sqrt, True)
square = _unary("square", lambda v: v * v, True)
tan = _unary("tan", F.tan, True)
tanh = _unary("tanh", F.tanh, True)
trunc = _unary("trunc", lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)), False)
bitwise_not = _unary("bitwise_not", lambda v: F.bitwise_not(v.cast("long")), False)
logical_not = _unary("logical_not", lambda v: ~v.cast("boolean"), False)
real = _unary("real", lambda v: v["re"], True)
imag = _unary("imag", lambda v: v["im"], True)
conj = _unary("conj", lambda v: F.struct(v["re"].alias("re"), (-v["im"]).alias("im")), True)


def angle(t: Tensor, deg: bool = False) -> Tensor:
    """Argument of complex cells."""
    a = F.atan2(F.col("v")["im"], F.col("v")["re"])
    return t.with_value(F.degrees(a) if deg else a)


def _binary(name: str, f: Callable[[Column, Column], Column], zero_zero: bool, inner: bool = False):
    """zero_zero: whether f(0, 0) = 0; inner: whether f is 0 as soon as one side is."""

    def g(t: Tensor, o: Tensor | float) -> Tensor:
        if not isinstance(o, Tensor):
            if not t.dense and not inner:
                raise TypeError(f"{name} of a sparse tensor and a scalar would not be sparse; use to_dense()")
            return t.with_value(f(F.col("v"), F.lit(o)))
        if t.dense != o.dense:
            raise TypeError(f"{name} mixes a sparse and a dense tensor")
        if t.shape != o.shape:
            raise ValueError(f"shapes {t.shape} and {o.shape} differ")
        if not t.dense and not zero_zero:
            raise TypeError(f"{name} of sparse tensors would not be sparse; use to_dense()")
        right = o.df.withColumnRenamed("v", "w")
        both = t.df.join(right, t.idx, "inner" if t.dense or inner else "full")
        if t.dense or inner:
            return Tensor(both.select(*t.idx, f(F.col("v"), F.col("w")).alias("v")), t.shape, t.dense)
        v, w = F.coalesce("v", F.lit(0)), F.coalesce("w", F.lit(0))
        return Tensor(both.select(*t.idx, f(v, w).alias("v")), t.shape)

    g.__name__, g.__doc__ = name, f"Elementwise {name} of two tensors of one shape, or of a tensor and a scalar."
    return g


def _logical(f):
    return lambda a, b: f(a.cast("boolean"), b.cast("boolean"))


add = _binary("add", lambda a, b: a + b, True)
subtract = _binary("subtract", lambda a, b: a - b, True)
multiply = _binary("multiply", lambda a, b: a * b, True, inner=True)
power = _binary("power", lambda a, b: F.pow(a, b), False)
true_divide = _binary("true_divide", lambda a, b: F.try_divide(a, b), False)
floor_divide = _binary("floor_divide", lambda a, b: F.floor(F.try_divide(a, b)), False)
fmod = _binary("fmod", lambda a, b: F.try_mod(a, b), False)
remainder = _binary("remainder", lambda a, b: F.when(b != 0, a - b * F.floor(a / F.nullif(b, F.lit(0)))), False)
bitwise_and = _binary("bitwise_and", lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), True, inner=True)
bitwise_or = _binary("bitwise_or", lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), True)
bitwise_xor = _binary("bitwise_xor", lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")), True)
logical_and = _binary("logical_and", _logical(lambda a, b: a & b), True, inner=True)
logical_or = _binary("logical_or", _logical(lambda a, b: a | b), True)
logical_xor = _binary("logical_xor", _logical(lambda a, b: a != b), True)
equal = _binary("equal", lambda a, b: a == b, False)


def _compare(t: Tensor, o, f) -> Tensor:
    return _binary("compare", f, True)(t, o) if t.dense or isinstance(o, Tensor) else t.with_value(f(F.col("v"), F.lit(o)))


def where(cond: Tensor, x: Tensor | float, y: Tensor | float) -> Tensor:
    """x where cond holds, else y; missing cells of sparse tensors are false and 0."""
    df, k = cond.df.withColumnRenamed("v", "c"), cond.idx
    how = "inner" if cond.dense else "full"
    cols = {}
    for name, t in (("x", x), ("y", y)):
        if isinstance(t, Tensor):
            df = df.join(t.df.withColumnRenamed("v", name), k, how)
        cols[name] = F.coalesce(F.col(name), F.lit(0)) if isinstance(t, Tensor) else F.lit(t)
    if not cond.dense and not isinstance(y, Tensor) and y != 0:
        raise TypeError("a non-zero scalar where a sparse condition fails would not be sparse")
    v = F.when(F.coalesce(F.col("c").cast("boolean"), F.lit(False)), cols["x"]).otherwise(cols["y"])
    return Tensor(df.select(*k, v.alias("v")), cond.shape, cond.dense)


# ---- reductions --------------------------------------------------------------------------------------------------

def _axes(t: Tensor, axis) -> list[int]:
    axis = range(t.ndim) if axis is None else [axis] if isinstance(axis, int) else axis
    return sorted(a % t.ndim for a in axis)


def _reduce(t: Tensor, axis, keepdims: bool, v: Callable[[int], Column]) -> Tensor:
    """v(cells): the aggregate of a group that has so many cells, implicit zeros included."""
    gone = _axes(t, axis)
    kept = [k for k in range(t.ndim) if k not in gone]
    n = math.prod(t.shape[k] for k in gone)
    out = t.df.groupBy(*[f"i{k}" for k in kept]).agg(v(n).alias("v"))
    if keepdims:
        cols = [F.lit(0).cast("long").alias(f"i{k}") if k in gone else F.col(f"i{k}") for k in range(t.ndim)]
        return Tensor(out.select(*cols, "v"), tuple(1 if k in gone else t.shape[k] for k in range(t.ndim)), t.dense)
    cols = [F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)]
    return Tensor(out.select(*cols, "v"), tuple(t.shape[k] for k in kept), t.dense or not kept)


def sum(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:  # noqa: A001
    return _reduce(t, axis, keepdims, lambda n: F.coalesce(F.sum("v"), F.lit(0)))


def mean(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    return _reduce(t, axis, keepdims, lambda n: F.coalesce(F.sum("v"), F.lit(0)) / n)


def var(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    """Population variance; implicit zeros count. Uses the group's moments: within + between cells and zeros."""

    def v(n: int) -> Column:
        c, m = F.count("v"), F.avg("v")
        return F.coalesce((c * F.var_pop("v") + c * (n - c) / n * m * m) / n, F.lit(0.0))

    return _reduce(t, axis, keepdims, v)


def std(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    return sqrt(var(t, axis, keepdims))


def prod(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    return _reduce(t, axis, keepdims, lambda n: F.when(F.count("v") == n, F.product("v")).otherwise(0.0))


def amax(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    return _reduce(t, axis, keepdims, lambda n: F.when(F.count("v") == n, F.max("v")).otherwise(F.greatest(F.max("v"), F.lit(0))))


def amin(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:
    return _reduce(t, axis, keepdims, lambda n: F.when(F.count("v") == n, F.min("v")).otherwise(F.least(F.min("v"), F.lit(0))))


def all(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:  # noqa: A001
    return _reduce(t, axis, keepdims, lambda n: (F.count("v") == n) & F.bool_and(F.col("v").cast("boolean")))


def any(t: Tensor, axis=None, keepdims: bool = False) -> Tensor:  # noqa: A001
    return _reduce(t, axis, keepdims, lambda n: F.coalesce(F.bool_or(F.col("v").cast("boolean")), F.lit(False)))


def median(t: Tensor, axis=-1, keepdims: bool = False) -> Tensor:
    _need_dense(t, "median")
    return _reduce(t, axis, keepdims, lambda n: F.percentile("v", 0.5))


def _arg(t: Tensor, axis, best) -> Tensor:
    """Lowest index on ties; without an axis the flat position."""
    _need_dense(t, "argmax and argmin")
    if axis is None:
        at, flat = _ravel(t.shape), Tensor(t.df, t.shape, True)
        return _reduce(flat, None, False, lambda n: best(at, F.struct("v", at)))
    axis %= t.ndim
    return _reduce(t, axis, False, lambda n: best(F.col(f"i{axis}"), F.struct("v", F.col(f"i{axis}"))))


def argmax(t: Tensor, axis=None) -> Tensor:
    return _arg(t, axis, lambda at, by: F.max_by(at, F.struct(by["v"], -at)))


def argmin(t: Tensor, axis=None) -> Tensor:
    return _arg(t, axis, lambda at, by: F.min_by(at, F.struct(by["v"], at)))


def argsort(t: Tensor, axis: int = -1) -> Tensor:
    """Index of the k-th smallest cell at position k; ties by index."""
    _need_dense(t, "argsort")
    axis %= t.ndim
    own = f"i{axis}"
    rest = [c for c in t.idx if c != own]
    if not rest:  # one long vector: numbered by ranges
        return Tensor(number(t.df, ["v", own], "k").select(F.col("k").alias(own), F.col(own).alias("v")), t.shape, True)
    w = W.partitionBy(*rest)
    out = t.df.withColumn("k", F.row_number().over(w.orderBy("v", own)).cast("long") - 1).withColumn("v", F.col(own)).withColumn(own, F.col("k"))
    return Tensor(out.select(*t.idx, "v"), t.shape, True)


def cumsum(t: Tensor, axis: int | None = None) -> Tensor:
    """Running sums along an axis; without one, of the flat tensor. Dense only."""
    _need_dense(t, "cumsum")
    t, axis = (reshape(t, (t.cells,)), 0) if axis is None else (t, axis % t.ndim)
    rest = [c for k, c in enumerate(t.idx) if k != axis]
    if not rest:
        return Tensor(prefix_sums(t.df, t.idx, {"_s": F.col("v")}).select(*t.idx, F.col("_s").alias("v")), t.shape, True)
    w = W.partitionBy(*rest)
    return t.with_value(F.sum("v").over(w.orderBy(f"i{axis}").rowsBetween(W.unboundedPreceding, 0)))


def cumprod(t: Tensor, axis: int | None = None) -> Tensor:
    _need_dense(t, "cumprod")
    t, axis = (reshape(t, (t.cells,)), 0) if axis is None else (t, axis % t.ndim)
    own, rest, cols = f"i{axis}", [c for k, c in enumerate(t.idx) if k != axis], [*t.idx, "v"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(own)
        return pdf.assign(v=pdf["v"].astype(float).cumprod())[cols]

    schema = ", ".join([f"{c} long" for c in t.idx] + ["v double"])
    if rest:
        return Tensor(t.df.groupBy(*rest).applyInPandas(run, schema), t.shape, True)
    ranged = cut(t.df.repartitionByRange(own).withColumn("_part", F.spark_partition_id()))  # products in ranges, times those of the ranges before
    totals = ranged.groupBy("_part").agg(F.product("v").alias("_t"))
    before = totals.select("_part", F.coalesce(F.product("_t").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)).alias("_b"))
    inside = ranged.groupBy("_part").applyInPandas(lambda pdf: run(pdf[cols]).assign(_part=pdf["_part"].iloc[0]), f"{schema}, _part int")
    return Tensor(inside.join(before, "_part").select(own, (F.col("v") * F.col("_b")).alias("v")), t.shape, True)


def bincount(t: Tensor, weights: Tensor | None = None, minlength: int = 0) -> DataFrame:
    """(value, n) for 0 .. largest value (or minlength), zeros included."""
    df = t.df.select(*t.idx, F.col("v").cast("long").alias("value"))
    if weights is not None:
        df = df.join(weights.df.withColumnRenamed("v", "w"), t.idx)
    n = F.sum("w") if weights is not None else F.count("*")
    counts = df.groupBy("value").agg(n.alias("n"))
    top = counts.agg(F.greatest(F.coalesce(F.max("value"), F.lit(-1)), F.lit(minlength - 1)).alias("top"))
    full = top.select(F.explode(F.when(F.col("top") >= 0, F.sequence(F.lit(0).cast("long"), F.col("top").cast("long")))).alias("value"))
    return full.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


# ---- products ----------------------------------------------------------------------------------------------------

def tensordot(a: Tensor, b: Tensor, axes=2) -> Tensor:
    """Sum over contracted axes: join on them, then grouped sum."""
    if isinstance(axes, int):
        axes = (list(range(a.ndim - axes, a.ndim)), list(range(axes)))
    left, right = ([x] if isinstance(x, int) else list(x) for x in axes)
    left, right = [k % a.ndim for k in left], [k % b.ndim for k in right]
    keep_a, keep_b = [k for k in range(a.ndim) if k not in left], [k for k in range(b.ndim) if k not in right]
    x = a.df.select(*[F.col(f"i{k}").alias(f"c{j}") for j, k in enumerate(left)], *[F.col(f"i{k}").alias(f"o{j}") for j, k in enumerate(keep_a)], F.col("v").alias("x"))
    y = b.df.select(*[F.col(f"i{k}").alias(f"c{j}") for j, k in enumerate(right)], *[F.col(f"i{k}").alias(f"o{len(keep_a) + j}") for j, k in enumerate(keep_b)], F.col("v").alias("y"))
    on = [f"c{j}" for j in range(len(left))]
    both = x.join(y, on) if on else x.crossJoin(y)  # an outer product has every pair as its result
    shape = (*[a.shape[k] for k in keep_a], *[b.shape[k] for k in keep_b])
    out = both.groupBy(*[F.col(f"o{j}").alias(f"i{j}") for j in range(len(shape))]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("v"))
    return Tensor(out, shape, a.dense or not shape)


def dot(a: Tensor, b: Tensor) -> Tensor:
    return tensordot(a, b, ([a.ndim - 1], [builtins.max(0, b.ndim - 2)]))


def matmul(a: Tensor, b: Tensor) -> Tensor:
    if a.ndim > 2 or b.ndim > 2:
        raise ValueError("matmul takes vectors and matrices")
    return dot(a, b)


def trace(t: Tensor) -> Tensor:
    return sum(diagonal(t))


# ---- shape -------------------------------------------------------------------------------------------------------

def reshape(t: Tensor, shape: Sequence[int]) -> Tensor:
    shape = list(shape)
    if -1 in shape:
        shape[shape.index(-1)] = t.cells // -math.prod(shape)
    if math.prod(shape) != t.cells:
        raise ValueError(f"cannot reshape {t.shape} to {tuple(shape)}")
    return Tensor(t.df.select(_ravel(t.shape).alias("flat"), "v").select(*_unravel(F.col("flat"), shape), "v"), tuple(shape), t.dense)


def transpose(t: Tensor, axes: Sequence[int] | None = None) -> Tensor:
    axes = list(axes) if axes is not None else list(range(t.ndim))[::-1]
    return Tensor(t.df.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(axes)], "v"), tuple(t.shape[k] for k in axes), t.dense)


def _move(t: Tensor, axis, f: Callable[[Column, int], Column]) -> Tensor:
    axes = _axes(t, axis)
    return Tensor(t.df.select(*[f(F.col(c), t.shape[k]).alias(c) if k in axes else F.col(c) for k, c in enumerate(t.idx)], "v"), t.shape, t.dense)


def flip(t: Tensor, axis=None) -> Tensor:
    return _move(t, axis, lambda c, n: n - 1 - c)


def roll(t: Tensor, shift: int, axis=None) -> Tensor:
    if axis is None:
        return reshape(roll(reshape(t, (t.cells,)), shift, 0), t.shape)
    return _move(t, axis, lambda c, n: F.pmod(c + shift, F.lit(n).cast("long")))


def rot90(t: Tensor, k: int = 1, axes: tuple[int, int] = (0, 1)) -> Tensor:
    order = list(range(t.ndim))
    order[axes[0]], order[axes[1]] = order[axes[1]], order[axes[0]]
    for _ in range(k % 4):
        t = transpose(flip(t, axes[1]), order)
    return t


def squeeze(t: Tensor, axis=None) -> Tensor:
    gone = [k for k in range(t.ndim) if t.shape[k] == 1] if axis is None else _axes(t, axis)
    if builtins.any(t.shape[k] != 1 for k in gone):
        raise ValueError("only modes of size 1 can be squeezed")
    kept = [k for k in range(t.ndim) if k not in gone]
    return Tensor(t.df.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)], "v"), tuple(t.shape[k] for k in kept), t.dense)


def concatenate(ts: Sequence[Tensor], axis: int = 0) -> Tensor:
    axis %= ts[0].ndim
    parts, at = [], 0
    for t in ts:
        parts.append(t.df.select(*[(F.col(c) + at).alias(c) if k == axis else F.col(c) for k, c in enumerate(t.idx)], "v"))
        at += t.shape[axis]
    return Tensor(fold(DataFrame.unionByName, parts), tuple(at if k == axis else n for k, n in enumerate(ts[0].shape)), ts[0].dense)


def stack(ts: Sequence[Tensor], axis: int = 0) -> Tensor:
    n = ts[0].ndim + 1
    axis %= n
    old = [k for k in range(n) if k != axis]
    parts = [t.df.select(*[F.lit(j).cast("long").alias(f"i{k}") if k == axis else F.col(f"i{old.index(k)}").alias(f"i{k}") for k in range(n)], "v") for j, t in enumerate(ts)]
    shape = list(ts[0].shape)
    shape.insert(axis, len(ts))
    return Tensor(fold(DataFrame.unionByName, parts), tuple(shape), ts[0].dense)


def split(t: Tensor, indices_or_sections, axis: int = 0) -> list[Tensor]:
    n = t.shape[axis]
    if isinstance(indices_or_sections, int):
        if n % indices_or_sections:
            raise ValueError("sections don't divide the axis")
        step = n // indices_or_sections
        cuts = list(range(step, n, step))
    else:
        cuts = list(indices_or_sections)
    return [t[tuple(slice(a, b) if k == axis % t.ndim else slice(None) for k in range(t.ndim))] for a, b in zip([0, *cuts], [*cuts, n])]


def take(t: Tensor, indices: Sequence[int]) -> Tensor:
    """Cells at flat positions, in the order asked for."""
    want = t.df.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(indices)], "i0 long, flat long")
    out = want.join(t.df.select(_ravel(t.shape).alias("flat"), "v"), "flat", "inner" if not t.dense else "left")
    return Tensor(out.select("i0", "v"), (len(indices),), t.dense)


def diag(t: Tensor, k: int = 0) -> Tensor:
    if t.ndim == 2:
        return diagonal(t, k)
    n = t.shape[0] + abs(k)
    return Tensor(t.df.select((F.col("i0") + builtins.max(0, -k)).alias("i0"), (F.col("i0") + builtins.max(0, k)).alias("i1"), "v"), (n, n))


def diagflat(t: Tensor, k: int = 0) -> Tensor:
    return diag(reshape(t, (t.cells,)), k)


def diagonal(t: Tensor, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Tensor:
    rest = [k for k in range(t.ndim) if k not in (axis1, axis2)]
    a, b = F.col(f"i{axis1}"), F.col(f"i{axis2}")
    n = builtins.max(0, builtins.min(t.shape[axis1] - builtins.max(0, -offset), t.shape[axis2] - builtins.max(0, offset)))
    cols = [F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(rest)]
    return Tensor(t.df.where(b == a + offset).select(*cols, (a - builtins.max(0, -offset)).alias(f"i{len(rest)}"), "v"), (*[t.shape[k] for k in rest], n), t.dense)


def _triangle(t: Tensor, keep: Column) -> Tensor:
    return t.with_value(F.when(keep, F.col("v")).otherwise(0)) if t.dense else Tensor(t.df.where(keep), t.shape)


def tril(t: Tensor, k: int = 0) -> Tensor:
    return _triangle(t, F.col(f"i{t.ndim - 1}") <= F.col(f"i{t.ndim - 2}") + k)


def triu(t: Tensor, k: int = 0) -> Tensor:
    return _triangle(t, F.col(f"i{t.ndim - 1}") >= F.col(f"i{t.ndim - 2}") + k)


def tril_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return grid(spark, (n, m or n)).where(F.col("i1") <= F.col("i0") + k)


def triu_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return grid(spark, (n, m or n)).where(F.col("i1") >= F.col("i0") + k)


def nonzero(t: Tensor) -> DataFrame:
    return t.df.where("v <> 0").select(*t.idx)


def unique(t: Tensor) -> DataFrame:
    """(v, n): distinct values and their counts; of a sparse tensor with implicit zeros, those too."""
    out = t.df.groupBy("v").agg(F.count("*").alias("n"))
    if t.dense:
        return out
    rest = t.df.agg(F.lit(0.0).alias("v"), (F.lit(t.cells).cast("long") - F.count("*")).alias("n")).where("n > 0")
    return out.unionByName(rest).groupBy("v").agg(F.sum("n").alias("n"))


def unique_inverse(t: Tensor) -> Tensor:
    """Each cell's position among the sorted distinct values."""
    _need_dense(t, "unique_inverse")
    ranks = number(t.df.select("v").distinct(), ["v"], "k")
    return Tensor(t.df.join(ranks, "v").select(*t.idx, F.col("k").alias("v")), t.shape, True)


# ---- creation ----------------------------------------------------------------------------------------------------

def full(spark: SparkSession, shape: Sequence[int], value: float, dtype: str = "float64") -> Tensor:
    return Tensor(grid(spark, shape).withColumn("v", F.lit(value).cast(DTYPES[dtype])), tuple(shape), True)


def zeros(spark: SparkSession, shape: Sequence[int], dtype: str = "float64", sparse: bool = False) -> Tensor:
    if sparse:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in _idx(len(shape))] + [T.StructField("v", T.DoubleType())])
        return Tensor(spark.createDataFrame([], schema), tuple(shape))
    return full(spark, shape, 0, dtype)


def ones(spark: SparkSession, shape: Sequence[int], dtype: str = "float64") -> Tensor:
    return full(spark, shape, 1, dtype)


empty = zeros


def full_like(t: Tensor, value: float, dtype: str = "float64") -> Tensor:
    return full(t.df.sparkSession, t.shape, value, dtype)


def zeros_like(t: Tensor, dtype: str = "float64") -> Tensor:
    return zeros(t.df.sparkSession, t.shape, dtype, sparse=not t.dense)


def ones_like(t: Tensor, dtype: str = "float64") -> Tensor:
    return full_like(t, 1, dtype)


empty_like = zeros_like


def eye(spark: SparkSession, n: int, m: int | None = None) -> Tensor:
    m = m or n
    return Tensor(spark.range(builtins.min(n, m)).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), (n, m))


def arange(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> Tensor:
    start, stop = (0, start) if stop is None else (start, stop)
    n = builtins.max(0, -(-(stop - start) // step))
    return Tensor(spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).alias("v")), (n,), True)


def linspace(spark: SparkSession, start: float, end: float, step: int) -> Tensor:
    """``step`` points from start to end."""
    gap = (end - start) / builtins.max(1, step - 1)
    return Tensor(spark.range(step).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * gap).alias("v")), (step,), True)


def logspace(spark: SparkSession, start: float, end: float, step: int, base: float = 10.0) -> Tensor:
    return linspace(spark, start, end, step).with_value(F.pow(F.lit(float(base)), F.col("v")))


def meshgrid(*ts: Tensor) -> list[Tensor]:
    """Coordinate tensors of vectors; the first vector varies along the second axis."""
    shape = [t.shape[0] for t in ts]
    order = list(range(len(ts)))
    order[:2] = order[:2][::-1]
    cells = grid(ts[0].df.sparkSession, [shape[k] for k in order])
    out = []
    for k, t in enumerate(ts):
        own = f"i{order.index(k)}"
        out.append(Tensor(cells.join(t.df.select(F.col("i0").alias(own), "v"), own).select(*_idx(len(ts)), "v"), tuple(shape[j] for j in order), True))
    return out


def can_cast(from_: str, to: str) -> bool:
    """Whether every value of one type fits the other."""
    if from_ == "int64" and to in ("float32", "float16", "complex64") or from_ == "int32" and to in ("float16", "float32", "complex64"):
        return False
    if from_ == "int8" and to == "uint8" or from_ == "int16" and to == "float16" or from_ in ("float64",) and to == "complex64":
        return False
    rank = {"short": "int16"}
    return _RANK.index(rank.get(from_, from_)) <= _RANK.index(rank.get(to, to))


def _need_dense(t: Tensor, what: str) -> None:
    if not t.dense:
        raise TypeError(f"{what} needs a dense tensor; use to_dense()")
