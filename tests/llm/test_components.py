"""Components of long paths, where labels have far to go."""

from __future__ import annotations

import random

import pytest

from siftwell.llm.components import connected


def descending(n):
    """1 - n - n-1 - ... - 2: the least id is next to the greatest."""
    return [1, *range(n, 1, -1)]


def shuffled(n):
    ids = list(range(1, n + 1))
    random.Random(n).shuffle(ids)
    return ids


@pytest.mark.parametrize("path", [descending(150), shuffled(400)], ids=["descending", "shuffled"])
def test_long_path_is_one_component(spark, path):
    links = [*zip(path, path[1:], strict=False), (1001, 1000), (1002, 1000), (1002, 1003), (7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in path} | {k: 1000 for k in range(1000, 1004)}


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
