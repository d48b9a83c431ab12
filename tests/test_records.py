"""CSV records across byte ranges against the csv module and a plain automaton."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabspark.sources import records, tables


def cells(rng):
    text = rng.choice(["", "x", "NA", 'a "quoted" word', "two\nlines", 'ends "\n', "\n\n", "comma, and \r\n more", '"', "long " * rng.randrange(40)])
    return text


def write(path, rng, n, columns=3, newline="\n"):
    rows = [[str(i), *[cells(rng) for _ in range(columns - 1)]] for i in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow([f"c{i}\nd" if i == 1 else f"c{i}" for i in range(columns)])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return rows


@pytest.mark.parametrize("line", ['a,b', '"a', '"a,b",c', 'x"y,"z', '"a""', '"a""b"', ',"', '"",""', 'a"', '"a"b"c,"d', '""', '"""'])
def test_state_follows_a_plain_automaton(line):
    for inside in (False, True):
        state, start = ("in" if inside else "out"), True
        i = 0
        while i < len(line):
            c = line[i]
            if state == "out" and start and c == '"':
                state = "in"
            elif state == "in" and c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = "after"
            elif state == "after" and c == ",":
                state = "out"
            start = c == "," and state == "out"
            i += 1
        assert records.ends_inside(line, inside, ",") == (state == "in"), (line, inside)


def pieces(text, bounds):
    """Lines of each byte range as Spark deals them out: a range has the lines that begin after its start."""
    starts, at = [], 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        starts.append((at, line))
        at += len(line.encode()) + 1
    out = []
    for first, last in zip(bounds, [*bounds[1:], 1 << 60]):
        out.append((first, [line for s, line in starts if (s > first or first == 0) and s <= last]))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_any_ranges_give_the_records_of_the_whole(tmp_path, seed):
    rng = random.Random(seed)
    rows = write(tmp_path / "a.csv", rng, 40)
    text = (tmp_path / "a.csv").read_text(newline="")
    bounds = [0, *sorted(rng.sample(range(1, len(text.encode())), rng.choice([0, 1, 5, 25])))]
    names = ["file", "start", "value"]
    dealt = [(b, lines) for b, lines in pieces(text, bounds) if lines]
    effects, begins, inside = {}, {}, False
    for start, lines in dealt:
        batch = pa.record_batch([pa.array(["f"] * len(lines)), pa.array([start] * len(lines)), pa.array(lines)], names=names)
        (effect,) = records._effects(",")(iter([batch]))
        effects[start] = effect.to_pylist()[0]
        begins[start] = inside
        inside = effects[start]["if_in"] if inside else effects[start]["if_out"]
    assert not inside

    def read(wanted):
        batches = []
        for start, lines in dealt:
            step = rng.choice([1, 3, 1000])
            for i in range(0, len(lines), step):
                part = lines[i : i + step]
                batches.append(pa.record_batch([pa.array(c) for c in (["f"] * len(part), [start] * len(part), part, [begins[start]] * len(part))], names=[*names, "inside"]))
        return [r for b in records._split(",", wanted)(iter(batches)) for r in b.to_pylist()]

    whole = read({records.WHOLE})
    chains, chain = {}, 0
    for r in sorted(read({records.HEAD, records.TAIL}), key=lambda r: (r["start"], r["part"])):
        chain += r["part"] == records.TAIL
        chains.setdefault(chain, []).append(r)
    found = [r["record"] for r in whole if not r["header"]]
    found += ["\n".join(r["record"] for r in c) for c in chains.values() if not any(r["header"] for r in c)]
    got = sorted(next(csv.reader(io.StringIO(r, newline=""))) for r in found)
    assert got == sorted(rows)
    assert sum(r["header"] for r in whole) + sum(any(r["header"] for r in c) for c in chains.values()) == 1


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, newline):
    """Ranges are at least 4 MB: a file of 24 MB, most of it inside quoted cells, is several tasks."""
    rng = random.Random(5)
    rows = [[str(i), "a line\nof " + '"words", ' * rng.randrange(60) + "\n\n" * rng.randrange(9) + "x" * 2000, cells(rng)] for i in range(9000)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerows([["id", "text", "t"], *rows])
    path = tmp_path / "large.csv"
    path.write_bytes(out.getvalue().encode())
    assert path.stat().st_size > 16 << 20
    df = tables.load_table(spark, str(path))
    found = records.csv_records(spark, str(path))
    assert found.agg(F.countDistinct("start")).first()[0] > 2
    got = {r["id"]: (r["text"], r["t"]) for r in df.collect()}
    assert df.schema["id"].dataType.simpleString() == "bigint" and len(got) == len(rows)
    assert got == {int(i): (t, None if u in ("", "NA") else u) for i, t, u in rows}


def test_folder_header_empty_lines_and_open_quote(spark, tmp_path):
    folder = tmp_path / "f.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f'\n"a",b\n\n{i},"x\n\ny"\n\n{i},\n')
    (folder / "part-9.csv").write_text("a,b")
    got = sorted((r["a"], r["b"]) for r in tables.load_table(spark, str(folder)).fillna("none").collect())
    assert got == sorted([(i, "x\n\ny") for i in range(3)] + [(i, "none") for i in range(3)])
    (tmp_path / "open.csv").write_text('a,b,c\n1,2,3\n1,"2,3\n4,5,6\n')
    with pytest.raises(ValueError, match="1 rows"):
        tables.load_table(spark, str(tmp_path / "open.csv"))
