"""Spelling variants, fill-in-the-middle and byte-level BPE against brute force, on small odd tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, fill_middle, spelling
from plumbline.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, word string, n long, ids string, output string, row long, k int"

ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "é ø 漢字 <|endoftext|> 'll  x ౜  y\x00z"),
    (5, "Wörterbuch wörterbuch " * 3000),
    (6, "tables <P> and chairs"),
    (6, "tables and chairs"),
    (6, "tables and chairs"),
    (None, "lonesome lonesome"),
    (7, "x" * 3000 + "  \n\n\n" + " " * 2000 + "'re we'll 12345 " * 200),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "w", 1, "i", "o", 2, 3) for k, t in rows], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


def variants(rows, least_chars=7, least_times=2, times_more=10):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least_chars
    words = {w: n for w, n in counts.items() if n >= least_times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        around = [o for o in words if o != w and near(w, o)]
        better = sorted((-words[o], o) for o in around if words[o] >= times_more * n)
        out[w] = (better[0][1] if better else None, n, len(around), -better[0][0] if better else None)
    found = {}
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        found[w] = (out[w][0], root, *out[w][1:])
    return found


def rows_by_word(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


FAMILIES = ["Kalender", "kalendar", "kalnder", "kaalender", "kalenders", "kalender", "straßenbahn", "strassenbahn", "Ärgerlich", "ärgerlich"]


def spelled():
    rows = [(k, " ".join([w] * (1 + (k * 7 + j * 13) % 5))) for j, w in enumerate(FAMILIES) for k in range(12 * j, 12 * j + 12)]
    rows += [(1000 + k, "kalendex " * 60 + "kalendxx " * 3 + "qalendex " * 700 + "ab" * 30 + " " + "ab" * 29 + "ac ") for k in range(3)]
    return rows + [(2000, "zeppelin-zeppelin zeppelim"), (2000, "zeppelin zeppelim"), *ODD]


def test_spelling_variants(spark):
    rows = spelled()
    want = variants(rows)
    assert any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())
    assert rows_by_word(spelling.spelling_variants(docs_of(spark, rows))) == want
    tight = spelling.spelling_variants(docs_of(spark, rows), filter_bytes=64, words_per_task=3)  # a round for each block
    assert rows_by_word(tight) == want
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_of(spark, []), times_more=1)


def test_spelling_ties_take_the_smallest_word(spark):
    rows = [(k, "bonanzas " * 30 + "bonanzaz " * 30 + "bonanza ") for k in range(2)]
    want = variants(rows)
    assert want["bonanza"][0] == "bonanzas"
    assert rows_by_word(spelling.spelling_variants(docs_of(spark, rows))) == want


def test_long_texts_are_counted_in_slices(spark):
    text = "alphabet " * 50 + "Betamaxes," * 50 + "x" * 900
    counted = spelling.count_words(docs_of(spark, [(9, text), (9, text)]), "doc_id", "text", 7, 2, slice_chars=10, most_held=2)
    counts = Counter()
    for run in re.findall("[a-z]+", lower(text)):
        h = zlib.crc32(f"9:{run}".encode())
        counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 2
    assert {r.word: r.n for r in counted.collect()} == dict(counts)


def test_rounds_hold_their_bound():
    rounds = spelling.rounds_of({7: 1000, 8: 40, 9: 3}, 512, 16)
    assert all(sum(blocks for blocks, _, _ in r.values()) <= 8 for r in rounds)
    shares = [r[7] for r in rounds if 7 in r]
    assert sorted(s for _, s, _ in shares) == list(range(shares[0][2])) and {c for r in rounds for c in r} == {7, 8, 9}


def formed(key, text, percent=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return (key, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle(spark):
    rows = [*ODD, *[(k, t) for k in range(100, 160) for t in ("  a\tb  c \n", "<", "one", " é<P x>  ")]]
    for percent in (0, 50, 100):
        got = fill_middle.fill_in_middle(docs_of(spark, rows), percent=percent, chunk_bytes=200)
        back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        want = Counter(formed(k, t, percent) for k, t in rows)
        assert Counter(tuple(r)[:6] for r in back) == want
        assert Counter((r.doc_id, r.back) for r in back) == Counter((k, t or "") for k, t in rows)
    assert {formed(k, t, 100)[2] for k, t in rows} == {"plain", "spm", "psm"}
    empty = fill_middle.fill_in_middle(docs_of(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


RUNS = ["x" * 500, " " * 120, "\n" * 90, "!" * 200, "'ll" * 60, "9" * 77, "we've  '' 's \n\n x", "é漢   ", "౜࢏\U00011de0 a"]


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (64, 16), (16, 8), (9, 4)])
def test_byte_bpe_agrees_with_the_library(spark, library, chunk, overlap):
    path, pattern, whole = library
    rows = [(k, t[:4000] if t else t) for k, t in ODD]
    rows += [(100 + i, "".join(RUNS[(i * 5 + j * j) % len(RUNS)] for j in range(1 + i % 7))) for i in range(40)]
    rows += [(200 + i, "a " * i + "'" + "re" * (i % 3) + " b") for i in range(60)]
    got = byte_bpe.encode_texts(docs_of(spark, rows), path, pattern, chunk_chars=chunk, overlap=overlap)
    back = byte_bpe.decode_ids(got, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == Counter((k, tuple(whole.encode_ordinary(t or ""))) for k, t in rows)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter((k, t or "") for k, t in rows)


def test_byte_bpe_glues_what_does_not_meet(spark, library):
    path, pattern, whole = library
    text = "start " + "y" * 700 + " \n" * 300 + "z" * 40 + " end"
    docs = docs_of(spark, [(1, text), (2, text), (2, text)])
    chunks = byte_bpe.with_ends(byte_bpe.chunks_of(docs, "doc_id", "text", 64, 16), pattern)
    places = byte_bpe.stitches(chunks, 16)
    assert places.where("stuck").count() > 3 and places.where("`from` is null").count() == 0
    met = byte_bpe.stitched(docs, pattern, "doc_id", "text", 64, 16)
    kept = met.withColumn("part", F.expr("substring(text, `from` + 1, to - `from`)")).groupBy("row")
    joined = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), "").alias("text"))
    assert [r.text for r in joined.collect()] == [text] * 3
    rows = byte_bpe.encode_texts(docs, path, pattern, chunk_chars=64, overlap=16).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 2] and all(list(r.ids) == whole.encode_ordinary(text) for r in rows)


def test_byte_bpe_digests_and_odd_tables(spark, library):
    path, pattern, whole = library
    ids = byte_bpe.encode_texts(docs_of(spark, ODD), path, pattern)
    got = Counter(tuple(r) for r in byte_bpe.digests(ids, path).collect())

    def row(key, text):
        found = whole.encode_ordinary(text or "")
        return (key, len(found), *(hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, found)).encode(), (text or "").encode())))

    assert got == Counter(row(k, t) for k, t in ODD)
    assert byte_bpe.digests(byte_bpe.encode_texts(docs_of(spark, []), path, pattern), path).count() == 0
    nulls = spark.createDataFrame([(1, None, b"old"), (2, [], b"old")], "doc_id long, ids array<int>, decoded binary")
    assert [(r.doc_id, r.decoded) for r in byte_bpe.decode_ids(nulls, path).sort("doc_id").collect()] == [(1, None), (2, b"")]
    with pytest.raises(ValueError):
        byte_bpe.encode_texts(docs_of(spark, []), path, pattern, chunk_chars=100, overlap=90)


def test_byte_bpe_query_against_the_library(spark, library, tmp_path):
    _, _, whole = library
    texts = [(1, "The quick  brown fox's 123 jumps\n\n"), (2, None), (3, "naïve " * 9000)]
    docs_of(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect():
        text = dict(texts)[r.doc_id] or ""
        ids = whole.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
