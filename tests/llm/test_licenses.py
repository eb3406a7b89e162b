"""License scans against exact containment in every window."""

import random

from logtide.llm import licenses as L


def test_pivots_and_bands():
    parts = {n: L.shingles(t.lower().replace(",", "").replace(".", "").split(), 5) for n, t in L.TEMPLATES.items()}
    pivots = set(L.pivot_words(parts, 0.8))
    for p in parts.values():
        free = [s for s in p if not pivots & set(s.split(" "))]
        assert len(free) < 0.8 * len(p)
    for n, window, c in ((1, 1, 0.8), (60, 75, 0.8), (8, 10, 0.8)):
        held = -(-int(c * n * 10) // 10)
        j = held / (n + window - held)
        assert (1 - j) ** L.bands_for(n, window, c, 0.999) <= 0.0011


def test_finds_whole_and_edited_notices(spark):
    rnd = random.Random(3)
    noise = lambda n: " ".join(f"x{rnd.randrange(999)}" for _ in range(n))
    apache, mit = L.TEMPLATES["Apache-2.0-notice"], L.TEMPLATES["MIT-text"]
    edited = mit.replace("without limitation", "with no limitation")
    rows = [
        (1, noise(40) + "\n" + apache + "\n" + noise(90)), (2, noise(7) + " " + edited), (3, noise(300)),
        (4, "this license is not one of the software licenses"), (5, "x ALL  rights\nreserved. y"), (6, apache[:120]),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.containment, r.word) for r in L.scan_licenses(t).collect()}
    assert got[1, "Apache-2.0-notice"][0] == 1.0 and got[1, "Apache-2.0-line"][0] == 1.0 and 0.8 <= got[2, "MIT-text"][0] < 1
    assert got[5, "rights-reserved"] == (1.0, 1) and got[6, "Apache-2.0-line"] == (1.0, 0)
    assert {i for i, _ in got} == {1, 2, 5, 6} and (6, "Apache-2.0-notice") not in got


def test_odd_rows(odd_docs, no_docs):
    assert L.scan_licenses(odd_docs).collect() == []
    assert L.scan_licenses(no_docs).collect() == []
