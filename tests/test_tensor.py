import io

import numpy as np
import pytest

from cairnmine.functions import tensor as t

A = np.array([[1.5, -2.0, 0.0], [0.0, 4.0, -0.5]])
B = np.array([[2.0, 0.0, 3.0], [1.0, -4.0, 2.0]])


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(), want, equal_nan=True)


@pytest.mark.parametrize("name", "ceil cos cosh exp expm1 floor sign sin sinh square tan tanh trunc".split())
def test_elementwise_dense(spark, name):
    same(getattr(t, name)(t.Tensor.from_numpy(spark, A)), getattr(np, name)(A))


def test_sparse_rules(spark):
    a, b = t.Tensor.from_numpy(spark, A, dense=False), t.Tensor.from_numpy(spark, B, dense=False)
    same(t.add(a, b), A + B)
    same(t.subtract(a, b), A - B)
    same(t.multiply(a, b), A * B)
    same(t.sin(a), np.sin(A))
    for f in (t.cos, t.exp, t.isnan):
        with pytest.raises(TypeError):
            f(a)
    with pytest.raises(TypeError):
        t.add(a, t.Tensor.from_numpy(spark, B))
    with pytest.raises(TypeError):
        t.add(a, 1.0)


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("axis", [None, 0, 1])
def test_reductions_count_zeros(spark, axis, dense):
    x = t.Tensor.from_numpy(spark, A, dense)
    for name in "sum mean var std prod all any".split():
        same(getattr(t, name)(x, axis), getattr(np, name)(A, axis))


@pytest.mark.parametrize("dense", [True, False])
def test_extremes(spark, dense):
    x = t.Tensor.from_numpy(spark, np.array([[-1.0, -2.0], [-3.0, 0.0]]), dense)
    same(x.max(1), [-1, 0])
    same(x.min(0), [-3, -2])


def test_order(spark):
    x = np.array([[3.0, 1.0, 3.0], [2.0, 2.0, 5.0]])
    d = t.Tensor.from_numpy(spark, x)
    same(t.argmax(d, 1), x.argmax(1))
    same(t.argmin(d, 0), x.argmin(0))
    assert t.argmax(d).to_numpy() == x.argmax() and t.argmin(d).to_numpy() == x.argmin()
    same(t.argsort(d), np.argsort(x, kind="stable"))
    same(t.cumsum(d, 0), x.cumsum(0))
    same(t.cumsum(d), x.cumsum())
    same(t.cumprod(d, 1), x.cumprod(1))
    same(t.median(d), np.median(x, -1))


def test_shape_functions(spark):
    x = np.arange(12.0).reshape(3, 4)
    d = t.Tensor.from_numpy(spark, x)
    same(t.reshape(d, (2, -1)), x.reshape(2, -1))
    same(t.transpose(d), x.T)
    same(t.flip(d), np.flip(x))
    same(t.roll(d, 3), np.roll(x, 3))
    same(t.roll(d, -1, 1), np.roll(x, -1, 1))
    for k in range(4):
        same(t.rot90(d, k), np.rot90(x, k))
    same(t.concatenate([d, d], 1), np.concatenate([x, x], 1))
    same(t.stack([d, d], 2), np.stack([x, x], 2))
    same(t.squeeze(t.reshape(d, (3, 1, 4))), x)
    for got, want in zip(t.split(d, 2, 1), np.split(x, 2, 1)):
        same(got, want)
    same(t.take(d, [5, 0, 11]), x.take([5, 0, 11]))
    same(t.diagonal(d, 1), np.diagonal(x, 1))
    same(t.diagonal(d, -1), np.diagonal(x, -1))
    same(t.diag(t.Tensor.from_numpy(spark, np.array([1.0, 2.0])), -1), np.diag([1.0, 2.0], -1))
    same(t.tril(d, 1), np.tril(x, 1))
    same(t.triu(d), np.triu(x))
    same(d[1:, 2], x[1:, 2])
    same(d[-1], x[-1])
    same(d[:, ::2], x[:, ::2])
    assert sorted(map(tuple, t.tril_indices(spark, 3).collect())) == sorted(zip(*np.tril_indices(3)))
    assert sorted(map(tuple, t.triu_indices(spark, 3, 1).collect())) == sorted(zip(*np.triu_indices(3, 1)))


def test_products(spark):
    a, b = t.Tensor.from_numpy(spark, A, False), t.Tensor.from_numpy(spark, B.T, False)
    same(t.dot(a, b), A @ B.T)
    same(t.matmul(a, b), A @ B.T)
    same(t.tensordot(a, t.Tensor.from_numpy(spark, B, False)), np.tensordot(A, B))
    same(t.trace(t.dot(a, b)), np.trace(A @ B.T))


def test_binary_dense(spark):
    x, y = np.array([7.0, -7.0, 5.0]), np.array([3.0, 3.0, -3.0])
    a, b = t.Tensor.from_numpy(spark, x), t.Tensor.from_numpy(spark, y)
    for name in "true_divide floor_divide fmod remainder".split():
        same(getattr(t, name)(a, b), getattr(np, name)(x, y))
    same(t.equal(a, b), x == y)
    i, j = t.Tensor.from_numpy(spark, np.array([6, 3])), t.Tensor.from_numpy(spark, np.array([5, 3]))
    same(t.bitwise_and(i, j), [4, 3])
    same(t.bitwise_or(i, j), [7, 3])
    same(t.bitwise_xor(i, j), [3, 0])
    same(t.bitwise_not(i), [-7, -4])
    same(t.logical_xor(a > 0, b > 0), np.logical_xor(x > 0, y > 0))
    same(t.where(a > 0, a, b), np.where(x > 0, x, y))


def test_creation_and_counts(spark):
    same(t.eye(spark, 2, 3), np.eye(2, 3))
    same(t.arange(spark, 2, 11, 3), np.arange(2, 11, 3))
    same(t.linspace(spark, 0, 1, 5), np.linspace(0, 1, 5))
    same(t.logspace(spark, 0, 2, 3), np.logspace(0, 2, 3))
    for got, want in zip(t.meshgrid(t.arange(spark, 2), t.arange(spark, 3)), np.meshgrid(range(2), range(3))):
        same(got, want)
    same(t.full(spark, (2, 2), 3), np.full((2, 2), 3.0))
    x = t.Tensor.from_numpy(spark, np.array([3, 1, 3]))
    assert sorted(map(tuple, t.bincount(x).collect())) == [(0, 0), (1, 1), (2, 0), (3, 2)]
    assert sorted(map(tuple, t.unique(t.Tensor.from_numpy(spark, A, False)).collect())) == [(-2.0, 1), (-0.5, 1), (0.0, 2), (1.5, 1), (4.0, 1)]
    same(t.unique_inverse(x), [1, 0, 1])
    assert t.can_cast("int8", "int64") and not t.can_cast("int64", "int8")


def test_complex(spark):
    df = spark.createDataFrame([(0, (3.0, 4.0))], "i0 long, v struct<re:double,im:double>")
    z = t.Tensor(df, (1,), True)
    assert t.real(z).to_numpy()[0] == 3 and t.imag(t.conj(z)).to_numpy()[0] == -4
    assert abs(t.angle(z).to_numpy()[0] - np.angle(3 + 4j)) < 1e-12


def test_duplicates_are_summed(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "a int, b int, w double")
    x = t.Tensor.from_columns(df, ["a", "b"], "w")
    assert x.shape == (3, 2)
    same(x, [[0, 5], [0, 0], [1, 0]])


@pytest.mark.parametrize("dense", [True, False])
def test_numpy_blocks_there_and_back(spark, dense, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_CELLS", 8)
    a = np.arange(2.0, 44.0).reshape(7, 2, 3) * (np.arange(42).reshape(7, 2, 3) % 3 > 0)
    x = t.Tensor.from_numpy(spark, a, dense)
    blocks = x.to_blocks().collect()
    assert sorted(b.lo for b in blocks) == list(range(7)) and all(np.load(io.BytesIO(b.data)).shape == (1, 2, 3) for b in blocks)
    back = t.Tensor.from_blocks(x.to_blocks(), a.shape, dense)
    assert (back.to_numpy() == a).all() and back.df.count() == x.df.count()


def test_tensor_from_numpy_keeps_the_array_off_the_driver(spark, sf, monkeypatch):
    from cairnmine import catalog

    def refused(*_):
        raise AssertionError("the whole array came to the driver")

    monkeypatch.setattr(t.Tensor, "to_numpy", refused)
    assert catalog.queries()["tensor_from_numpy"](spark, sf).count() == 64 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
