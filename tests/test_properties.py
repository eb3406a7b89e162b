"""Property tests: the column parsers against Python's ``re`` on random lines."""

import random
import re

from logtide.functions import parse as P

WORDS = ["INFO", "WARN", "ERROR", "DEBUG", "INFORMATION", "info", "XWARN", "ERRORS", "app.X:", "comp.Y:", ":", " ",
         "17/03/29", "10:04:43", "1/2/3", "task", "\t", "-", "0", "12"]


def random_lines(n=600, seed=11):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(WORDS) for _ in range(rnd.randrange(0, 8))]
        line = rnd.choice(["", " ", ""]).join(parts) if rnd.random() < 0.3 else " ".join(parts)
        if rnd.random() < 0.4:
            line = f"{rnd.randrange(0, 100):02d}/{rnd.randrange(0, 20):02d}/{rnd.randrange(0, 40):02d} " \
                   f"{rnd.randrange(0, 30):02d}:{rnd.randrange(0, 70):02d}:{rnd.randrange(0, 70):02d} " + line
        out.append(line)
    return out


def py_level(v, word):
    m = re.search(r"\b(INFO|WARN|ERROR|DEBUG)\b" if word else r"(INFO|WARN|ERROR|DEBUG)", v)
    return m.group(1) if m else ""


def py_component(v):
    m = re.search(r"(INFO|WARN|ERROR|DEBUG)\s+([^:]+):", v)
    return m.group(2) if m else ""


def py_ts_text(v):
    m = re.match(r"(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})", v)
    return m.group(1) if m else ""


def test_line_parsers_match_python(spark):
    lines = random_lines()
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = df.select(
        "value",
        P.log_level("value").alias("s"),
        P.log_level("value", "word").alias("w"),
        P.component("value").alias("c"),
        P.ts_text("value").alias("t"),
    ).collect()
    assert len(rows) == len(lines)
    for r in rows:
        assert r.s == py_level(r.value, False), r.value
        assert r.w == py_level(r.value, True), r.value
        assert r.c == py_component(r.value), r.value
        assert r.t == py_ts_text(r.value), r.value


def test_path_ids_match_python(spark):
    rnd = random.Random(5)
    paths = []
    for _ in range(300):
        c = str(rnd.randrange(10**12, 10**13))
        a = str(rnd.randrange(0, 10**rnd.randrange(1, 6)))
        pieces = [rnd.choice(["s3a://b", "file:/x", "/data"]), rnd.choice([f"application_{c}_{a}", "misc", f"app_{c}"]),
                  rnd.choice([f"container_{c}_{a}_01_{rnd.randrange(1, 10):06d}.log", "stderr", "x.log"])]
        paths.append("/".join(pieces))
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    rows = df.select("file_path", *P.path_ids("file_path"), P.container_number("file_path").alias("n")).collect()
    for r in rows:
        m = re.search(r"(application_\d+_\d+)", r.file_path)
        app = m.group(1) if m else ""
        assert r.application_id == app
        num = re.search(r"application_\d+_(\d+)", app).group(1) if app else ""
        assert r.app_number == (num if len(num) >= 4 or not num else num.zfill(4))
        assert r.cluster_id == (re.search(r"application_(\d+)_\d+", app).group(1) if app else "")
        cm = re.search(r"container_\d+_\d+_\d+_(\d+)", r.file_path)
        assert r.n == (int(cm.group(1)) if cm else None)
