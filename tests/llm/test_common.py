from __future__ import annotations

import threading
from pathlib import Path

import pytest

from plyweave.llm.common import materialize, scratch, shared_dir


def written(spark, name):
    return {p.name for p in Path(shared_dir(spark)).glob(f"{name}-*")}


def test_scratch_removes_what_is_not_kept(spark):
    with scratch(spark) as keep:
        materialize(spark.range(3), "lost")
        with scratch(spark) as inner:
            inside = inner(spark.range(4), "inside")
        out = keep(inside, "out")
    assert (len(written(spark, "lost")), len(written(spark, "inside")), out.count()) == (0, 0, 4)


def test_scratch_removes_all_after_an_error(spark):
    with pytest.raises(ValueError), scratch(spark) as keep:
        keep(spark.range(3), "broken")
        materialize(spark.range(3), "broken")
        raise ValueError
    assert not written(spark, "broken")


def test_scratch_leaves_other_threads_alone(spark):
    ends, begun = threading.Event(), threading.Event()
    found = []

    def other():
        with scratch(spark):
            df = materialize(spark.range(5), "theirs")
            begun.set()
            ends.wait(60)
            found.append(df.count())

    thread = threading.Thread(target=other)
    with scratch(spark):
        thread.start()
        begun.wait(60)
        materialize(spark.range(3), "mine")
    ends.set()
    thread.join()
    assert found == [5] and not written(spark, "theirs") and not written(spark, "mine")
