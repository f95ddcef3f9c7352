"""Text operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    automaton,
    chat,
    decontaminate,
    fingerprints,
    language,
    mixing,
    near_duplicates,
    quality,
    secret_scan,
    substrings,
    token_counts,
)
from plumbline.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n long, id string, h long, score double"


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(k, t, (langs or {}).get(k), (sources or {}).get(k, "s"), 0, 1, "x", 2, 0.5) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(k, n=60):
    return " ".join(f"word{k}x{i * i % 97}" for i in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é ø 漢字 <|endoftext|> 'll  x"), (5, sentence(5, 6000)), (6, sentence(6)), (6, sentence(6)), (None, "lone")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def test_fingerprints(spark, odd, empty):
    assert fingerprints.fingerprint_versions(empty).count() == 0
    texts = [(k, "\n".join(f"{sentence(k, 9)} {j}" for j in range(k % 40))) for k in range(0, 90, 2)] + [(7, None), (9, "one line")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_versions(docs_of(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: -x[0])

    def parts(t):
        return {p.strip(" ") for p in re.findall(r"[^\n]{1,160}", t)} - {""}

    def like(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].near_edited == pytest.approx(like(parts(t), parts(edited)))
        assert got[k].near_next == pytest.approx(like(parts(t), parts(after)))
    rows = fingerprints.fingerprint_versions(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id == 6}) == 1


def test_a_pair_that_never_peels_is_an_error(spark):
    told = spark.createDataFrame([(1, list(range(1, 3001)), [])], "rid long, own array<long>, new array<long>")
    with pytest.raises(RuntimeError, match="peels"):
        fingerprints.differing(told, {"edited": ("own", "new")}, 0)


def test_token_counts(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(odd, path, chunk_bytes=300).collect()
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in ODD]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    rarely = token_counts.token_counts(odd, path, chunk_bytes=300, most_frequent=4).collect()
    assert sorted(map(str, rarely)) == sorted(map(str, got))
    assert token_counts.token_counts(empty, path).count() == 0


def test_ascii_texts_are_cut_as_the_library_cuts_them():
    public = pytest.importorskip("public_tokenizers")
    from pathlib import Path

    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library, cut = Tokenizer.from_file(path).pre_tokenizer, token_counts._cutter(Path(path).read_text())
    rnd = np.random.default_rng(8)
    for _ in range(3000):
        some = rnd.choice(128, 12)
        text = "".join(map(chr, rnd.choice([*some, 32, 39, 115, 10], 30)))
        assert cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def brute_secrets(text):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_secrets_equal_the_patterns(spark, odd, empty):
    rnd = np.random.default_rng(3)
    bits = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abc", "abcdef0123", "secret", "AKIA", "ABCDEFGHIJ012345", "é", "\n", ",", "0a1b2c3d4e5f"]
    texts = ["".join(rnd.choice(bits, 30)) for _ in range(400)] + ["", "x" * 9000 + "secret=token: abcdefgh"]
    base = {"assign", "access", "hex"}
    for text, spans in zip(texts, secret_scan.secrets_in(texts), strict=True):
        assert [s for s in spans if s[0] in base] == brute_secrets(text), text
    assert len(secret_scan.scan_secrets(odd).collect()) == len(ODD) and secret_scan.scan_secrets(empty).count() == 0
    one = docs_of(spark, [(1, 'say token = "abcdef99" now'), (2, None), (3, "clean")])
    got = secret_scan.redact_secrets(one).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["say [SECRET] now".replace("[SECRET]", "[SECRET]\""), None, "clean"] and one.columns == list(got[0].asDict())


def test_automaton_is_minimal_and_counts():
    one = automaton.compile_rules(["a{2,3}b|c"], anchored=True)
    assert [one.longest(x, 0, len(x)) for x in (b"aab", b"aaab", b"aaaab", b"ab", b"c")] == [3, 4, -1, -1, 1]
    assert automaton.compile_rules(["ab|ab"], anchored=True).states == automaton.compile_rules(["ab"], anchored=True).states


def test_mixing(spark, odd, empty):
    assert mixing.mix_sources(empty).count() == 0
    texts = [(k, " ".join(["w"] * (1 + k * 7 % 40))) for k in range(600)]
    sources = {k: None if k % 3 == 0 else f"s{k % 6}" for k, _ in texts}
    docs = docs_of(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == 1 + r.doc_id * 7 % 40 and r.taken == r.copies * r.size <= 2 * r.size
        size[sources[r.doc_id]] += r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    order = sorted(x for x in size if x) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, free, want = 1.5 * sum(size.values()), set(size), {}
    while True:
        part = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * size[s]}
        if not over:
            want |= part
            break
        want |= {s: 2.0 * size[s] for s in over}
        free -= over
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 80
    assert len(mixing.mix_sources(odd).collect()) == len(ODD)


def test_mix_of_rows_alike(spark):
    """Rows of no id and one size are dealt over buckets like any others, and lie apart in their draws."""
    docs = spark.range(0, 20_000, 1, 16).selectExpr("cast(null as long) doc_id", "'a b c' text", "if(id % 4 = 0, 'x', null) source")
    counted = docs.selectExpr("cast(doc_id as string) id", "source", "3L size").groupBy("id", "source", "size").count().withColumnRenamed("count", "n")
    copies = mixing._numbered(counted).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m"))
    assert {(r.source, r.n, r.d, r.m) for r in copies.collect()} == {("x", 5_000, 5_000, 4_999), (None, 15_000, 15_000, 14_999)}
    count = lambda df: sorted((str(r.source_size), r.taken, r["count"]) for r in df.groupBy("source_size", "taken").count().collect())
    one = mixing.mix_sources(docs)
    for r in one.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect():
        assert abs(r.taken - r.target) <= 3 and r.n * 3 == r.source_size
    assert count(one) == count(mixing.mix_sources(docs.repartition(3)))


def test_leaks(spark, odd, empty):
    bench = spark.createDataFrame([(1, sentence(50, 40)), (2, sentence(51, 20)), (3, None), (4, "two words")], "item_id long, text string")
    near = sentence(50, 40).split()
    near[20] = "other"
    texts = [(1, f"{sentence(8)} {sentence(50, 40).upper()}. {sentence(9)}"), (2, " ".join(near)), (3, sentence(8)), (4, None), (5, sentence(51, 12))]
    texts += [(k, f"intro {sentence(51, 20)}") for k in range(20, 60)]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    grams = lambda w: Counter(zip(*(w[k:] for k in range(5)), strict=False))
    a, b = grams(near), grams(sentence(50, 40).split())
    alike = sum((a & b).values()) / sum((a | b).values())
    want = {(1, 1): 1.0, **{(k, 2): 1.0 for k in range(20, 60)}} | ({(2, 1): alike} if alike >= 0.8 else {})
    assert got == pytest.approx(want)
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_every_item_text_is_found(spark):
    one, two, three = sentence(60, 20), sentence(61, 20), sentence(62, 30)
    rows = [(1, "two words"), (2, "漢字仮名"), (3, one), (3, two), (None, three), (4, "yes"), (5, None), (6, " .")]
    bench = spark.createDataFrame(rows + rows[:1], "item_id long, text string")
    texts = [(1, "now Two, words and two words"), (2, "a。漢字仮名。b"), (3, f"x {one}"), (4, f"y y {two} z"), (5, three), (6, f"{one} {two}"), (7, "two other words"), (8, "words"), (9, "漢字")]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    assert got == {(1, 1): (1.0, 1), (2, 2): (1.0, 1), (3, 3): (1.0, 1), (4, 3): (1.0, 2), (5, None): (1.0, 0), (6, 3): (1.0, 0)}


def test_leaks_just_at_the_similarity_are_all_found(spark):
    rnd = np.random.default_rng(11)
    words = lambda n: [f"w{x:x}" for x in rnd.integers(0, 2**60, n)]
    items, texts, want = [], [], {}
    for k in range(450):
        item = words((39, 59, 50)[k % 3])
        own = len(item) - 4
        # the most words at the end that can differ, or be cut off, at a similarity of 0.8
        differ, cut = (max(x for x in range(own) if f(x) >= 0.8) for f in (lambda x: (own - x) / (own + x), lambda x: (own - x) / own))
        text = item[: len(item) - differ] + words(differ) if k % 2 else item[: len(item) - cut]
        items.append((k, " ".join(item)))
        texts.append((k, " ".join(words(30) + text + words(30) if k % 2 else text)))
        want[k, k] = (own - differ) / (own + differ) if k % 2 else (own - cut) / own
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    assert min(want.values()) == 0.8 and max(want.values()) < 0.85 and got == pytest.approx(want)


def _best_windows(text, items, words=5, least=0.8):
    """By brute force: every window of every item's length, each compared whole."""
    grams = lambda w: Counter(tuple(w[k : k + words]) for k in range(len(w) - words + 1))
    found = {}
    for key, item in items.items():
        want = grams(item)
        for start in range(max(0, len(text) - len(item)) + 1):
            here = grams(text[start : start + len(item)])
            alike = sum((here & want).values()) / max(1, sum((here | want).values()))
            if alike >= least and alike > found.get(key, (0, 0))[0]:
                found[key] = (alike, start)
    return found


def test_leaks_against_every_window(spark):
    """Items edited, cut, shifted, turned round and in another order, beside a search of all windows."""
    rnd = np.random.default_rng(23)
    pool = [f"v{x:x}" for x in range(60)]
    draw = lambda n: [f"w{x:x}" for x in rnd.integers(0, 2**60, n)]
    items, texts = {}, {}
    for k in range(240):
        n = (15, 39, 59)[k % 3]
        item = draw(n) if k % 4 else list(rnd.choice(pool, n))
        at, half = int(rnd.integers(1, n - 1)), n // 2
        kinds = [
            item[:at] + draw(1) + item[at:],
            item[:at] + item[at + 1 :],
            item[2:] if k % 2 else item[:-2],
            item[at:] + item[:at],
            item[half:] + item[:half],
            item[1:at] + draw(1) + item[at:] + item[:1],
            item[:-1] + draw(1),
            item + item[: n // 3],
        ]
        items[k] = item
        told = kinds[k // 3 % 8]
        texts[k] = told if k % 11 == 0 else draw(int(rnd.integers(0, 9))) + told + draw(7)
    texts[900], texts[901] = sum((items[k] for k in range(8)), []), items[1][:-1] + items[1]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    docs = docs_of(spark, [(k, " ".join(x)) for k, x in texts.items()])
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {(k, j): v for k, x in texts.items() for j, v in _best_windows(x, items).items()}
    assert len(want) > 140 and got.keys() == want.keys()
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})


def test_leaks_do_not_touch_other_columns(spark):
    item = sentence(60, 20)
    docs = docs_of(spark, [(None, f"a {item}"), (None, "clean"), (1, None), (1, item)]).selectExpr("*", "'x' row_key", "'y' _leaked")
    left = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text, r.row_key, r._leaked) for r in left.collect()} == {(None, "clean", "x", "y"), (1, None, "x", "y")}


def test_repeats(spark, odd, empty):
    shared = sentence(70, 45)
    texts = [(k, f"{sentence(k, 20)} {shared} {sentence(k + 500, 20)}") for k in range(30)] + [(40, sentence(40, 200)), (41, sentence(40, 200))]
    texts += [(42, f"{sentence(42, 36)} mid {sentence(42, 36)}"), *ODD]
    docs = docs_of(spark, texts)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, group_bytes=4000).collect())
    split = [(k, (t or "").encode().split()) for k, t in texts]
    seen = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    want = Counter()
    for k, w in split:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    assert got == want and substrings.remove_repeats(empty).count() == 0


def test_quality(spark, odd, empty):
    good = [(k, f"The {sentence(k, 30 + k % 9)}. And so on, {sentence(k + 3, 9)}.") for k in range(120)]
    bad = [(k, "SPAM!! " * (20 + k % 7)) for k in range(120, 200)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(200)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and held and all(r.predicted == int(r.doc_id < 120) for r in held)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == set(range(120))
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def test_language(spark, odd, empty):
    texts = [(k, ("der die und ist nicht " if k % 2 else "the and is not of ") * 8) for k in range(60)] + [(90, None), (91, "12 !"), (92, "")]
    langs = {k: "de" if k % 2 else "en" for k in range(60)}
    got = {r.doc_id: r for r in language.predict_language(docs_of(spark, texts, langs)).collect()}
    assert all(got[k].lang_pred == langs[k] for k in range(60)) and {got[k].lang_pred for k in (90, 91, 92)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values()) and language.predict_language(empty).count() == 0
    assert {r.lang_pred for r in language.predict_language(odd).collect()} == {"und"}
    signs = ["½", "²³", "①② ①", "Ⅷ", "12 _ !", "\u0301"]
    mixed = docs_of(spark, [*texts, *((5000 + k, s) for k, s in enumerate(signs)), (6000, "ª")], langs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(mixed).collect()}
    assert all(found[5000 + k] == ("und", 0.0) for k in range(len(signs))) and found[6000][0] != "und"


def test_language_against_plain_dictionaries(spark):
    """Profiles as plain dictionaries: ranked n-grams of one to three characters, out-of-place distance, ties by code."""
    words = {"aa": ["banana", "canal", "salad", "Mañana"], "ee": ["letter", "EERIE", "teeth", "été"], "oo": ["mosso", "lotto"]}
    rows = [(k, " ".join(words[w][(k * j) % len(words[w])] for j in range(1, 9)), w) for i, w in enumerate(words) for k in range(i, 90, 3)]

    def grams(text):
        clean = re.sub(r"[\W\d_]+", "_", text.lower()).strip("_")
        padded = f"_{clean}_"
        found = [c for c in padded if c != "_"] + [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]

        def code(g):
            out = 0
            for c in g:
                out = out << 21 | ord(c)
            return out

        return Counter(map(code, found))

    def ranked(counts, most):
        return sorted(counts, key=lambda g: (-counts[g], g))[:most]

    for most in (30, 400):
        profiles = {}
        for lang in words:
            added = sum((grams(t) for k, t, w in rows if w == lang and zlib.crc32(str(k).encode()) % 3 != 1), Counter())
            profiles[lang] = {g: i for i, g in enumerate(ranked(added, most))}
        docs = docs_of(spark, [(k, t) for k, t, _ in rows], {k: w for k, _, w in rows})
        for r in language.predict_language(docs, most=most).collect():
            mine = ranked(grams(next(t for k, t, _ in rows if k == r.doc_id)), most)
            far = {x: sum(abs(p[g] - i) if g in p else most for i, g in enumerate(mine)) for x, p in profiles.items()}
            best = min(far, key=lambda x: (far[x], x))
            assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (most * len(mine)))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_near_duplicates(spark, odd, empty):
    rnd = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(80)]
        for c in range(6):
            copy = list(base)
            for i in rnd.integers(0, 80, c):
                copy[i] = f"edit{rnd.integers(1000)}"
            texts.append((len(texts), " ".join(copy)))
    texts += [(200, "a b"), (201, "A B"), (202, None), (203, "")]
    got = {r.doc_id: r for r in near_duplicates.near_duplicate_groups(docs_of(spark, texts), words=4).collect()}
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()) for k, t in texts for w in [(t or "").lower().split()]}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[k]] == root[k] for k in root):
            break
    assert {k: r.component_id for k, r in got.items()} == root and all(r.n_shingles == len(sets[k]) for k, r in got.items())
    assert near_duplicates.near_duplicate_groups(empty).count() == 0
    assert len(near_duplicates.near_duplicate_groups(odd).collect()) == len(ODD)
    assert near_duplicates.keep_one_of_each(odd).where("doc_id = 6").count() == 1


def test_rows_are_kept_and_dropped_by_id_and_text(spark):
    one, two, near = sentence(80), sentence(81), f"{sentence(80, 59)} end"
    texts = [(None, one), (None, two), (None, None), (7, one), (7, two), (7, one), (3, near), (9, None), (9, ""), (9, "")]
    got = Counter((r.doc_id, r.text) for r in near_duplicates.keep_one_of_each(docs_of(spark, texts)).collect())
    assert got == Counter([(None, one), (None, two), (None, None), (7, two), (3, near), (9, None), (9, "")])
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    left = Counter((r.doc_id, r.text) for r in decontaminate.drop_leaks(docs_of(spark, texts), bench).collect())
    assert left == Counter(x for x in texts if x[1] not in (one, near))


def test_every_bin_fills_and_agrees_like_the_sets():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:450], rnd.integers(0, 2**63, 50).astype(np.uint64)])
    one, two = (near_duplicates.similarity_sketch(x, 288) for x in (a, b))
    assert abs((one == two).mean() - 450 / 550) < 0.1
    assert (near_duplicates.similarity_sketch(a[:1], 288) != np.uint64(2**64 - 1)).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 91: 90}


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<|turn|>\\", "<|says|><\\|done|>", "", "é" * 5]
    for text in hard:
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, None)]
    rows += [(1, 5, 99, "user", "orphan", 0.0), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (3, None, None, "user", "x", 0.0)]
    nodes = spark.createDataFrame(rows + rows[:1], "tree long, node long, parent long, role string, text string, score double")
    got = chat.format_trees(nodes).collect()
    assert [(r.tree, r.leaf) for r in got] == [(1, 4)]
    assert chat.read_back(got[0].formatted) == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert chat.masked(got[0].formatted, [(m.start, m.end) for m in got[0].loss_mask]) == "good"
    assert chat.format_trees(nodes.limit(0)).count() == 0
    long = spark.createDataFrame([(7, k, "user" if k % 2 else "assistant", hard[k % 5]) for k in range(70)], "c long, t long, r string, x string")
    row = chat.digests(chat.format_trees(chat.replies_in_order(long, "c", "t", "r", "x"))).first()
    told = "".join(f"{'user' if k % 2 else 'assistant'}\n{hard[k % 5]}\n" for k in range(70))
    assert row.n_turns == 70 and row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {"start": {r.doc_id for r in docs.collect()}}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id for r in docs.collect()}
    first = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(list(left["quality_classifier"])))
    groups = near_duplicates.near_duplicate_groups(first, words=5).where("kept").collect()
    assert left["near_dedup"] == {r.doc_id for r in groups} and left["secret_scans"] == left["decontamination"]
    assert not any(secret_scan.secrets_in([r.text for r in docs.collect()])[0])
    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == left["secret_scans"]
