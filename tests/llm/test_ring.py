"""Sharding against a ring that is walked row by row."""

import bisect
import collections

import pytest
from pyspark.sql import functions as F

from strandline.llm import sharding


def walked(nodes, points, shards):
    """points: point by key. Shard, slot and own shard by key: own rows first, in ring order; the others go on clockwise."""
    room = [len(points) // shards + (s < len(points) % shards) for s in range(shards)]
    used, out, waiting = collections.Counter(), {}, []
    last = nodes[-1][0]
    # Behind the last node the ring begins anew, with the first node's arc.
    rows = sorted((bisect.bisect_left([p for p, _ in nodes], x) % len(nodes), x <= last, x, key) for key, x in points.items())
    for arc, _, _, key in rows:
        own = nodes[arc][1]
        if used[own] < room[own]:
            out[key] = (own, used[own], own)
            used[own] += 1
        else:
            waiting.append((arc, key, own))
    for arc, key, own in waiting:
        at = arc + 1
        while used[nodes[at % len(nodes)][1]] >= room[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        out[key] = (shard, used[shard], own)
        used[shard] += 1
    return out


@pytest.mark.parametrize("shards, vnodes, n", [(4, 8, 1500), (3, 1, 400), (5, 64, 7)])
def test_rows_lie_where_the_walk_puts_them(spark, shards, vnodes, n):
    docs = spark.range(n).selectExpr("id * 7 - 300 as doc_id", "cast(id as string) as text")
    points = {r.doc_id: r.point for r in docs.select("doc_id", F.xxhash64("doc_id").alias("point")).collect()}
    out = {r.doc_id: (r.shard, r.slot, r.own_shard) for r in sharding.shard_documents(docs, shards, vnodes).collect()}
    assert out == walked(sharding.ring(spark, shards, vnodes), points, shards)
