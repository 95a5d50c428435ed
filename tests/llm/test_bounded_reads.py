"""What the training-data operators read to the driver, and the bound of each read."""

from tests.test_no_driver_collect import PKG, pulls

# File and code of each read, and why it is small at any input size.
BOUNDED = {
    ("common.py", "limit(1).count()"): "one number",
    ("common.py", "rows = df.count()"): "one number",
    ("common.py", "F.log2(column)"): "512 buckets",
    ("components.py", "edges.count()"): "one number",
    ("covertree.py", ".limit(wanted).toArrow()"): "4096 centres of 2^20 components, from about twice as many rows",
    ("covertree.py", "limit(1).toArrow()"): "one row",
    ("covertree.py", "F.max(F.size("): "one number",
    ("covertree.py", "limit(1).count()"): "one number",
    ("decontaminate.py", "distinct().collect()"): "lengths of short items: six",
    ("decontaminate.py", ".first()"): "one number",
    ("decontaminate.py", "seeds.count()"): "one number",
    ("alignment.py", "toArrow()"): "HEAD rows, by a threshold",
    ("maxent.py", "rows = got.count()"): "one number",
    ("maxent.py", "got.collect()"): "four partial models",
    ("maxent.py", ".toArrow()"): "FREQUENT rows, by a threshold",
    ("mixing.py", "limit(1).count()"): "one number",
    ("secrets.py", "SAMPLE"): "SAMPLE rows a label, from about twice as many",
    ("warc.py", "DICT_PAGES"): "DICT_PAGES heads, from about twice as many",
    ("warc.py", "manifest.count()"): "one number",
    ("minhash.py", 'groupBy("id").count()'): "not a read: a grouped count",
}


def test_every_read_has_a_bound():
    found = list(pulls(PKG / "llm"))
    assert [x for x in found if not any(x[0] == f and part in x[2] for f, part in BOUNDED)] == []
