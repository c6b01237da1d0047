"""Pixels straight from files: the same as over tiles, with one Python step less."""

import numpy as np
import pyarrow as pa
import pytest

from chronofold.plans import catalog
from chronofold.sources import formats, images


@pytest.mark.parametrize("resize", [None, "3x5"])
def test_as_over_tiles(spark, resize):
    r = np.random.default_rng(44)
    shapes = [(1, 1, 1), (4, 6, 3), (7, 5, 4), (9, 11, 1), (21, 3, 3)]  # tiles of 4 x 4: one, and several with short edges
    rows = [(f"f{i}", i, formats.encode_png(r.integers(0, 60000 if i % 2 else 256, shape).astype(np.uint16 if i % 2 else np.uint8))) for i, shape in enumerate(shapes)]
    rows += [("wide", 7, formats.encode_tiff(r.integers(0, 1 << 32, (5, 6, 3)).astype(np.uint32))), ("again", 1, rows[1][2])]
    rows += [("none", 8, None), ("empty", 9, b""), ("junk", 10, b"junk"), ("cut", 11, rows[1][2][:-30])]
    files = spark.createDataFrame(rows, "path string, id long, content binary").repartition(2)
    kept = ["path", "id"]
    found = images.file_pixels(files, *kept, resize=resize, edge=4)
    cut = images.tiles(files, resize, edge=4).join(files.select(*kept), "path")
    wanted = images.pixels(cut, *kept, edge=4)
    assert found.schema == wanted.schema
    told = sorted(map(tuple, found.collect()))
    assert told == sorted(map(tuple, wanted.collect()))
    decoded = {path: formats.decode(content) for path, _, content in rows if content and path not in ("junk", "cut")}
    if not resize:
        assert told == sorted((path, i, y, x, c, int(v)) for path, i, _ in rows if path in decoded for (y, x, c), v in np.ndenumerate(decoded[path]))
    assert {row[0] for row in told} == set(decoded)


def test_small_pieces_leave_together():
    batch = pa.RecordBatch.from_pydict({"id": list(range(9000))})
    pieces = ((i, 0, 0, np.full((4, 4, 1), i % 256, np.uint8)) for i in range(9000))
    out = list(images._unrolled(batch, ["id"], pieces))
    assert [x.num_rows for x in out] == [images.MANY, images.MANY, 9000 * 16 - 2 * images.MANY]
    ids = np.concatenate([x.column("id").to_numpy() for x in out])
    assert np.array_equal(ids, np.repeat(np.arange(9000), 16)) and np.array_equal(np.concatenate([x.column("v").to_numpy() for x in out]), ids % 256)
    assert not list(images._unrolled(batch, ["id"], iter([])))


@pytest.mark.parametrize("name", ["image_resize", "image_stack"])
def test_python_steps(spark, name):
    """One Python process of a core draws the files, one decodes and unrolls them."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
