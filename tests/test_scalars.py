import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylamp.functions import text, urls, vectors
from quarrylamp.operators.english import english_stem


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTP://Quarry.Test": "http://quarry.test/",
        "http://lamp.test/": "http://lamp.test/",
        "http://lamp.test/oil/wick/": "http://lamp.test/oil/wick",
        "http://lamp.test:80/oil#top": "http://lamp.test/oil",
        "https://quarry.test:443": "https://quarry.test/",
        "http://quarry.test?stone=slate#vein": "http://quarry.test/?stone=slate",
        " http://me:pw@Host:8080/a//?q=1 ": "http://host:8080/a?q=1",
        "http://[2001:DB8::1]:80/x": "http://[2001:db8::1]/x",
        "mailto:someone@lamp.test": None,
        "https://": None,
        "http://host:99999/": None,
        "not a url": None,
    }
    assert values(spark, list(cases), urls.canonical_url) == list(cases.values())


def test_normalize_is_lenient(spark):
    cases = {
        "HTTP://Lamp.TEST:80/wick/#x": "http://lamp.test/wick",
        "ftp://Host/a/": "ftp://host/a",
        "/für/": "/f%C3%BCr",
        "http://h/%zz": "http://h/%zz",
    }
    assert values(spark, list(cases), urls.normalize_url) == list(cases.values())


def test_resolve_links(spark):
    base = "https://a.example.com/x/y?q=1"
    cases = {
        "https://b.example.com/z": "https://b.example.com/z",
        "//c.example.com/z": "https://c.example.com/z",
        "/z": "https://a.example.com/z",
        "z?p=2": "https://a.example.com/x/z?p=2",
        "../z": "https://a.example.com/z",
        "#top": "https://a.example.com/x/y?q=1#top",
        "mailto:x@y": None,
        "  ": None,
    }
    resolved = values(spark, list(cases), lambda c: urls.resolve_link(F.lit(base), c))
    assert resolved == list(cases.values())


def test_display_and_space(spark):
    assert values(spark, ["https://Ex.com:8/a%20b?x"], urls.display_host) == ["https://Ex.com:8"]
    assert values(spark, ["https://Ex.com:8/a%20b?x"], urls.display_path) == ["/a b"]
    assert values(spark, [" a \n b\t"], text.collapse_space) == ["a b"]
    assert values(spark, ["é" * 600], text.snippet) == ["é" * 500]


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(1)
    sample = np.concatenate([rng.standard_normal(500), rng.standard_normal(200) * 1e-5, [0.0]])
    sample = sample.astype(np.float32)
    got = values(spark, [float(x) for x in sample], vectors.half_value, "v double")
    assert got == [float(x) for x in sample.astype(np.float16)]


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("zero"),
        vectors.l2_normalize(F.col("a")).alias("unit"),
    ).first()
    assert row["zero"] == 0.0
    assert row["unit"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="expected 3"):
        df.select(vectors.check_dimensions(F.col("a"), 3)).collect()


@pytest.mark.parametrize(
    "word,stem",
    [
        ("consigned", "consign"), ("consisting", "consist"), ("happy", "happi"),
        ("relational", "relat"), ("generously", "generous"), ("knightly", "knight"),
        ("ties", "tie"), ("cries", "cri"), ("hopping", "hop"), ("hoping", "hope"),
        ("dying", "die"), ("news", "news"), ("say", "say"), ("sensational", "sensat"),
    ],
)
def test_english_stems(word, stem):
    assert english_stem(word) == stem


def test_same_host_without_taking_plain_urls_apart(spark):
    from quarrylamp.functions.urls import same_host, source_host

    urls = ["http://a.com/x", "http://a.com", "https://a.com/x/y", "http://A.com/x", "http://a.com:80/z", "http://b.com/x",
            "http://u@a.com/x", "a.com/x", "/x/y/z", "", "http:///x", "http://[::1]/x", "http://a.com?x=/y/z", None, " http://a.com/x"]
    pairs = spark.createDataFrame([(a, b) for a in urls for b in urls], "a string, b string")
    both = pairs.select("a", "b", same_host(F.col("a"), F.col("b")).alias("got"), (source_host(F.col("a")) == source_host(F.col("b"))).alias("want"))
    assert both.filter("not (got <=> want)").collect() == []


def test_vectors_stored_at_half_precision(spark):
    from quarrylamp.operators.nearest import nearest
    from quarrylamp.sources.halves import pack_halves, unpack_halves

    rows = [(1, [1.0, -0.1, 65519.0]), (2, None), (3, []), (4, [6e-8, 1 / 3, 0.0]), (5, [float("nan"), float("inf"), 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    packed = pack_halves(df)
    assert packed.schema["embedding"].dataType.simpleString() == "binary"
    assert {r.id: r.embedding and len(r.embedding) for r in packed.collect()} == {1: 6, 2: None, 3: b"", 4: 6, 5: 6} | {3: bytearray()}
    got = {r.id: r.embedding for r in unpack_halves(packed).collect()}
    for k, vector in rows:
        want = None if vector is None else np.array(vector, np.float32).astype(np.float16).astype(np.float32).tolist()
        assert got[k] is want or np.array_equal(got[k], want, equal_nan=True)
    big = spark.createDataFrame([(1, [70000.0, 1.0])], "id long, embedding array<float>")
    asked = big.withColumnRenamed("id", "query_id")
    for refused in (pack_halves(big), big.select(vectors.half_precision(F.col("embedding")))):
        with pytest.raises(Exception, match="out of range for half precision"):
            refused.collect()
    with pytest.raises(Exception, match="out of range for half precision"):
        nearest(asked, big, 1, half=True).collect()
    with pytest.raises(Exception, match="null component"):
        pack_halves(spark.createDataFrame([(1, [None, 1.0])], "id long, embedding array<float>")).collect()
    assert pack_halves(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from quarrylamp.sources.tables import shared_folder

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="spark://host:7077"))
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


def test_ends_and_blanks_are_told_without_reading_whole_texts(spark):
    from quarrylamp.functions.text import is_blank, strip_space

    spaces = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　"]
    inner = ["", "a", "a b", "größe\n\nx", "\U0001f600", "a​b", "\x00"]
    texts = [None, *inner, *spaces, *(s + t + 2 * s for s in spaces for t in inner), *(s + t for s in spaces for t in inner), *(t + s for s in spaces for t in inner)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", strip_space(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b"))
    trimmed = lambda t: t if t is None else t.strip("".join(spaces))
    assert [(r.t, r.s, r.b) for r in found.collect()] == [(t, trimmed(t), not trimmed(t)) for t in texts]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in plan and plan.count("regexp_replace") == 1  # at the ends first; a blank is no stripped text


def test_first_and_last_lines_of_stored_texts(spark, tmp_path):
    from quarrylamp import testbed
    from quarrylamp.workloads import document_messages

    texts = [None, "", "one", "one\n", "\n", "\ntwo", "one\ntwo\nthree", "one\r\ntwo\n\n"]
    rows = [(k, t, "en", "web", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for read in (testbed.documents, document_messages):
        table = read(spark, str(tmp_path))
        found = {int(r.url.split("/doc/")[1].split("/")[0]): (r.title, r.description) for r in table.collect()}
        assert found == {k: (None, None) if t is None else (t.split("\n")[0], t.split("\n")[-1]) for k, t in enumerate(texts)}
        assert "split(" not in table._jdf.queryExecution().optimizedPlan().toString()
