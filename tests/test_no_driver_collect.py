"""Jobs never pull data to the driver. The few reads that remain are listed with their bound; the
training-data operators have a list of their own (tests/llm)."""

import pathlib
import re

PKG = pathlib.Path(__file__).resolve().parents[1] / "inkwell"
PULL = re.compile(r"\.(collect|toPandas|take|toLocalIterator|toArrow|head|tail)\(|(?<!F)\.first\(|\.count\(\)(?!\))")
# File and code of each read, and why it is small.
BOUNDED = {
    ("io.py", "limit(1).collect()"): "one header line",
    ("request_queue.py", ".toArrow().to_pylist()"): "a trained model: at most terms + 1 rows a class",
}


def pulls(folder):
    for f in sorted(folder.glob("**/*.py")):
        for i, line in enumerate(f.read_text().splitlines(), 1):
            code = line.split("#")[0]
            if PULL.search(code) and not re.search(r"F\.count\(|\.take\(pa\.|gc\.collect", code):
                yield f.name, i, code.strip()


def test_no_collect_in_jobs():
    folders = [d for d in PKG.iterdir() if d.is_dir() and d.name != "llm"]      # llm is optional
    found = [x for d in folders for x in pulls(d)]
    assert [x for x in found if not any(x[0] == f and part in x[2] for f, part in BOUNDED)] == []
    assert len(found) == len(BOUNDED)
