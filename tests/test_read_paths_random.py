"""Random file bodies: lines and records against a plain Python reading."""

import os
import random
import re

import pytest

from logtide.operators import records as RC
from logtide.sources.logs import read_logs

PIECES = ["17/03/29 10:04:43 INFO a.B: msg", "17/03/29 10:04:44 ERROR c.D: boom", "\tat x.y(Z.java:1)", "",
          "caused by: e", "17/13/40 10:00:00 WARN bad", "ü ñ 漢", "INFORMATION only", " "]
BREAKS = ["\n", "\r\n", "\r"]


def write_random_files(root, n=30, seed=3):
    rnd = random.Random(seed)
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 12)):
            parts.append(rnd.choice(PIECES))
            parts.append(rnd.choice(BREAKS))
        if parts and rnd.random() < 0.3:
            parts.pop()  # no final line break
        with open(os.path.join(root, f"f{i:02d}.log"), "w", encoding="utf-8", newline="") as f:
            f.write("".join(parts))


def expected(body):
    """(lines, records as (record_no, text)) of one file."""
    lines = re.split(r"\r\n|\r|\n", body)
    if lines[-1] == "":
        lines.pop()
    recs, no = [], 0
    for line in lines:
        if re.match(r"\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", line):
            no += 1
            recs.append((no, [line]))
        elif no:
            recs[-1][1].append(line)
        else:
            recs.append((0, [line]))
    return lines, [(n, "\n".join(x)) for n, x in recs]


@pytest.mark.parametrize("seed,whole", [(3, None), (7, None), (3, 1 << 20), (7, 100)])
def test_random_bodies(spark, tmp, seed, whole):
    write_random_files(tmp, seed=seed)
    lines, recs = {}, {}
    for r in read_logs(spark, tmp, with_order=True, whole_bytes=whole).orderBy("file_path", "line_order").collect():
        lines.setdefault(os.path.basename(r.file_path), []).append(r.value)
    for r in RC.read_records(spark, tmp, whole_bytes=whole).orderBy("file_path", "record_no", "part").collect():
        recs.setdefault(os.path.basename(r.file_path), []).append((r.record_no, r.text))
    for name in os.listdir(tmp):
        with open(os.path.join(tmp, name), encoding="utf-8", newline="") as f:
            want = expected(f.read())
        assert (lines.get(name, []), recs.get(name, [])) == want, name
