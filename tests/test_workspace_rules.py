"""Ignore rules against git itself, limits, cancellation, debounced changes."""

import os
import random
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from lattica.operators import fixpoint
from lattica.sources import scan
from lattica.storage import Cancelled, cancel, cancellable, shared_dir

NAMES = ["a", "b", "build", "x.ttl", "y.ttl", "z.owl", "tmp", "é", "a b.ttl", "#h.ttl", "!n.ttl", "v1.ttl"]
RULES = ["*.ttl", "!x.ttl", "build/", "/a", "tmp", "!tmp", "a/b", "**/b/*.ttl", "a/**", "!a/x.ttl", "/b/**/y.ttl", "[xy].ttl", "[!x].ttl", "v?.ttl", "# note", "", "\\#h.ttl", "\\!n.ttl", "a b.ttl  ", "é/", "!build/x.ttl", "*", "!*/", "b/**/", "z.*", "\\*.ttl"]


@pytest.mark.parametrize("seed", range(4))
def test_ignore_rules_equal_git(spark, tmp_path, seed):
    rng, root = random.Random(seed), tmp_path / "root"
    root.mkdir()
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    folders = [root]
    for _ in range(12):
        f = rng.choice(folders) / rng.choice(["a", "b", "build", "tmp", "é"])
        f.mkdir(exist_ok=True)
        folders.append(f)
    for f in folders:
        for n in rng.sample(NAMES[3:6] + NAMES[8:], 5):
            (f / n).write_text("x")
        if rng.random() < 0.5 or f == root:
            (f / ".gitignore").write_text("\n".join(rng.sample(RULES, rng.randint(1, 5))) + rng.choice(["", "\n", "\r\n"]))
    paths = [os.path.join(d, n) for d, _, names in os.walk(root) if ".git" not in d.split("/") for n in names if n != ".gitignore"]
    told = subprocess.run(["git", "-C", str(root), "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths).encode(), capture_output=True).stdout.decode().split("\0")
    rules = scan.ignore_rules(scan.ignore_files(spark, [str(root)], 12))
    kept = {r.path for r in scan.not_ignored(spark.createDataFrame([(p, 1) for p in paths], "path string, folder int"), rules).collect()}
    assert kept == set(paths) - set(told)
    assert {r.path for r in scan.scan_files(spark, [str(root)]).collect()} == {p for p in kept if p.endswith((".ttl", ".owl"))}


def test_jail_and_limits(spark, tmp_path):
    for n in ("a.ttl", "b.ttl"):
        (tmp_path / n).write_text("x" * 50)
    assert scan.scan_files(spark, [str(tmp_path)], most_files=2, most_bytes=50).count() == 2
    for limits in ({"most_files": 1}, {"most_bytes": 49}):
        with pytest.raises(scan.TooMuch):
            scan.scan_files(spark, [str(tmp_path)], **limits)
    paths = spark.createDataFrame([("/r/a.ttl",), ("/r/../x.ttl",), ("/rx/a.ttl",), ("/r/s/..",), ("/r/..a/b.ttl",)], "path string")
    assert {r.path for r in scan.inside(paths, ["/r/"]).collect()} == {"/r/a.ttl", "/r/..a/b.ttl"}


def test_a_running_fixpoint_is_cancelled_and_leaves_no_tables(spark):
    folder = shared_dir(spark).removeprefix("file://")
    edges = spark.range(5000).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    one = spark.createDataFrame([("0",)], "a string")
    before, outcome = set(os.listdir(folder)), []

    def work():
        try:
            with cancellable(spark, "slow"):
                outcome.append(fixpoint.closure(edges, one).count())
        except Cancelled as e:
            outcome.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    while len(set(os.listdir(folder)) - before) < 4:
        time.sleep(0.05)
    began = time.time()
    cancel(spark, "slow")
    thread.join(30)
    assert time.time() - began < 20 and len(outcome) == 1 and isinstance(outcome[0], Cancelled)
    assert set(os.listdir(folder)) - before == set()
    with cancellable(spark, "slow"):
        assert fixpoint.closure(edges.limit(3), one).count() == 3
