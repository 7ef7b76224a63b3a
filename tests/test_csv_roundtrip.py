"""The parse reads back what a standard CSV writer wrote (one line per record)."""

import csv
import io
import random

from glmframe.sources.csv_matrix import parse_lines

BLANKS = "".join(chr(i) for i in range(0x21))
WIDTH = 5


def random_cell(rnd: random.Random) -> str:
    alphabet = 'ab ,"x1.-'
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 6)))


def test_parse_matches_python_csv(spark):
    rnd = random.Random(5)
    records = [[random_cell(rnd) for _ in range(WIDTH)] for _ in range(300)]
    lines = []
    for rec in records:
        buf = io.StringIO()
        csv.writer(buf, quoting=csv.QUOTE_MINIMAL, lineterminator="").writerow(rec)
        lines.append(buf.getvalue())
    header = [f"h{i}" for i in range(WIDTH)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i INT, value STRING")
    want = {i: [c.strip(BLANKS) for c in rec] for i, rec in enumerate(records)}

    rows = parse_lines(df.select("value"), header).collect()
    assert sorted([list(r["_cells"]) for r in rows]) == sorted(want.values())
