"""Spelling variants of words: edits probed against Bloom filters by length, what they let through joined exactly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pieces_of, written

#: Fixed value: the letters a word is made of once A-Z are lower-cased; each is one byte in Latin-1.
LETTERS = "a-zÀ-ÿ"
#: A filter block holds eight lanes of 64 bits; a word sets one bit in each lane of one block.
LANES = 8
#: The multipliers and shifts of a well-known 64-bit mixing function (fixed values).
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def count_words(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    least_chars: int,
    least_times: int,
    one_in: int = 31,
    slice_chars: int = 1_000_000,
    most_held: int = 200_000,
) -> DataFrame:
    """Rows (word, n) of the corpus: runs of letters, one in ``one_in`` of them (by a checksum of id and run) short of a letter.

    A task adds up what it reads and gives it out whenever ``most_held`` words are held; a long text is walked in slices that
    end outside a run, so beside the text itself little is held.
    """

    def run(batches):
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        long_run, outside, held = re.compile(f"[{LETTERS}]{{{least_chars},}}"), re.compile(f"[^{LETTERS}]"), Counter()

        def given():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()

        for piece in pieces_of(batches, "text", 4_000_000):
            for key, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                seed = crc32(f"{key}:".encode())
                text, start = (text or "").encode().lower().decode(), 0  # bytes lower only A-Z
                while start < len(text):
                    stop = outside.search(text, start + slice_chars) if start + slice_chars < len(text) else None
                    end = stop.start() if stop else len(text)
                    for word, n in Counter(long_run.findall(text, start, end)).items():
                        check = crc32(word.encode(), seed)
                        if check % one_in == 0:
                            k = check % len(word)
                            word = word[:k] + word[k + 1 :]
                        if len(word) >= least_chars:
                            held[word] += n
                    start = end
                    if len(held) > most_held:
                        yield from given()
        yield from given()

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    added = named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return added.where(F.col("n") >= least_times)


def _mixed(x):
    """64-bit numbers, well mixed."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _letter_hash(places, letters):
    """A random number for each letter at each place; a word's hash is the exclusive or of those of its letters."""
    import numpy as np

    return _mixed((places.astype("u8") * np.uint64(256) + letters.astype("u8") + np.uint64(1)) * np.uint64(GOLDEN))


def _matrix(words: list[str]):
    """Words of one length as rows of Latin-1 codes."""
    import numpy as np

    return np.frombuffer("".join(words).encode("latin-1"), "u1").reshape(len(words), -1)


def _word_hash(codes):
    import numpy as np

    return np.bitwise_xor.reduce(_letter_hash(np.arange(codes.shape[1])[None, :], codes), axis=1)


def _share_of(hashes, shares: int):
    """Which share of its length's words a word belongs to, where one filter is too small for all of them."""
    import numpy as np

    return _mixed(hashes ^ np.uint64(GOLDEN)) % np.uint64(shares)


def _block_and_bits(hashes, blocks: int):
    import numpy as np

    again = _mixed(hashes + np.uint64(GOLDEN))
    return (hashes >> np.uint64(16)) % np.uint64(blocks), [(again >> np.uint64(6 * i)) & np.uint64(63) for i in range(LANES)]


def rounds_of(counts: dict[int, int], filter_bytes: int, bits: int) -> list[dict[int, tuple[int, int, int]]]:
    """Rounds of filters of at most ``filter_bytes`` together: for each length (blocks, share, shares).

    Lengths go into rounds in order; a length that needs more than a round has alone is dealt by hash to several.
    """
    most = max(1, filter_bytes // (LANES * 8))
    rounds, room = [], 0
    for chars, n in sorted(counts.items()):
        blocks = -(-n * bits // (LANES * 64))
        shares = -(-blocks // most)
        for share in range(shares):
            need = min(most, -(-blocks // shares))
            if need > room:
                rounds.append({})
                room = most
            rounds[-1][chars] = (need, share, shares)
            room -= need
    return rounds


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        out.setdefault(len(word), []).append(k)
    return out


def build_filters(vocabulary: DataFrame, plan: dict[int, tuple[int, int, int]]) -> dict:
    """The filters of one round, merged block by block with a bitwise or; ``plan`` bounds what comes to the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = batch.column("word").to_pylist()
            for chars, rows in _by_length(words).items():
                blocks, share, shares = plan[chars]
                hashes = _word_hash(_matrix([words[k] for k in rows]))
                hashes = hashes[_share_of(hashes, shares) == share]
                block, places = _block_and_bits(hashes, blocks)
                lanes = [pa.array((np.uint64(1) << p).view("i8")) for p in places]
                columns = [pa.array(np.full(len(hashes), chars, "i4")), pa.array(block.astype("i8")), *lanes]
                yield pa.RecordBatch.from_arrays(columns, names=["chars", "block", *(f"l{i}" for i in range(LANES))])

    shape = "chars int, block long, " + ", ".join(f"l{i} long" for i in range(LANES))
    merged = (
        vocabulary.where(F.col("chars").isin(list(plan)))
        .mapInArrow(run, shape)
        .groupBy("chars", "block")
        .agg(*(F.bit_or(f"l{i}").alias(f"l{i}") for i in range(LANES)))
        .toArrow()
    )
    filters = {chars: np.zeros((blocks, LANES), "u8") for chars, (blocks, _, _) in plan.items()}
    of, at = merged.column("chars").to_numpy(), merged.column("block").to_numpy()
    lanes = np.stack([merged.column(f"l{i}").to_numpy().view("u8") for i in range(LANES)], axis=1)
    for chars, blocks in filters.items():
        blocks[at[of == chars]] = lanes[of == chars]
    return filters


def _passing(hashes, blocks, share: int, shares: int):
    """Places of the flat hashes that a filter lets through: lane after lane, over those that are left."""
    import numpy as np

    left = np.flatnonzero(_share_of(hashes, shares) == share) if shares > 1 else np.arange(len(hashes))
    at = (hashes[left] >> np.uint64(16)) % np.uint64(len(blocks))
    again = _mixed(hashes[left] + np.uint64(GOLDEN))
    for i in range(LANES):
        has = (blocks[at, i] >> ((again >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) != 0
        left, at, again = left[has], at[has], again[has]
    return left


def _edits_through(words: list[str], alphabet, plan: dict, filters: dict, most: int = 1 << 20):
    """(number of the word, edit) for the edits of words of one length that a filter of the round lets through.

    Of a pair that differs by a letter only the smaller word makes the edit, of one that differs in length only the longer:
    each pair comes up once. The hash of an edit follows from the word's without walking the word again.
    """
    import numpy as np

    chars = len(words[0])
    per_batch = max(1, most // max(chars, len(alphabet)))
    for start in range(0, len(words), per_batch):
        some = words[start : start + per_batch]
        codes, places = _matrix(some), np.arange(chars)
        own = _letter_hash(places[None, :], codes)
        whole = np.bitwise_xor.reduce(own, axis=1)
        if chars in plan:
            blocks, (_, share, shares) = filters[chars], plan[chars]
            wide = max(1, most // (len(some) * len(alphabet)))
            for p in range(0, chars, wide):
                there = places[p : p + wide]
                bare = whole[:, None] ^ own[:, p : p + wide]
                edited = bare[:, :, None] ^ _letter_hash(there[:, None], alphabet[None, :])[None, :, :]
                word, place, letter = np.nonzero(alphabet[None, None, :] > codes[:, p : p + wide, None])
                for k in _passing(edited[word, place, letter], blocks, share, shares):
                    text, at = some[word[k]], p + place[k]
                    yield start + word[k], text[:at] + chr(alphabet[letter[k]]) + text[at + 1 :]
        if chars - 1 in plan:
            blocks, (_, share, shares) = filters[chars - 1], plan[chars - 1]
            zero = np.zeros((len(some), 1), "u8")
            before = np.concatenate([zero, np.bitwise_xor.accumulate(own, axis=1)[:, :-1]], axis=1)
            moved = _letter_hash(places[None, :-1], codes[:, 1:])
            after = np.concatenate([np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1], zero], axis=1)
            differs = np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((len(some), 1), bool)], axis=1)
            word, place = np.nonzero(differs)  # of equal letters in a row only the last is taken out
            for k in _passing((before ^ after)[word, place], blocks, share, shares):
                text, at = some[word[k]], place[k]
                yield start + word[k], text[:at] + text[at + 1 :]


def probe(vocabulary: DataFrame, alphabet: str, plan: dict, filters: dict, words_per_task: int, n_words: int) -> DataFrame:
    """Rows (word, n, edit): edits of the words that the round's filters let through, false ones among them."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        letters = np.frombuffer(alphabet.encode("latin-1"), "u1")
        for batch in batches:
            words, times = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for rows in _by_length(words).values():
                found = list(_edits_through([words[k] for k in rows], letters, plan, shared.value))
                at = [rows[k] for k, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([words[k] for k in at], pa.string()),
                        pa.array([times[k] for k in at], pa.int64()),
                        pa.array([edit for _, edit in found], pa.string()),
                    ],
                    names=["word", "n", "edit"],
                )

    lengths = sorted({chars + d for chars in plan for d in (0, 1)})
    given = vocabulary.where(F.col("chars").isin(lengths)).select("word", "n")
    return given.repartition(max(1, -(-n_words // words_per_task)), "word").mapInArrow(run, "word string, n long, edit string")


def near_words(vocabulary: DataFrame, filter_bytes: int, bits: int, words_per_task: int) -> DataFrame:
    """Rows (word, n, other, other_n), one for each two words of ``vocabulary`` (word, n, chars) that are one edit apart."""
    counts = {r["chars"]: r["count"] for r in vocabulary.groupBy("chars").count().collect()}
    used = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter != ''").distinct()
    alphabet = "".join(sorted(r["letter"] for r in used.collect()))  # at most the 90 letters of LETTERS
    through = None
    for plan in rounds_of(counts, filter_bytes, bits):
        filters = build_filters(vocabulary, plan)
        found = written(probe(vocabulary, alphabet, plan, filters, words_per_task, sum(counts.values())), "edits")
        through = found if through is None else through.unionByName(found)
    if through is None:
        return vocabulary.selectExpr("word", "n", "word AS other", "n AS other_n").where("false")
    other = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return through.join(other, through["edit"] == other["other"]).select("word", "n", "other", "other_n")


def roots_of(forms: DataFrame, most_steps: int) -> DataFrame:
    """Rows (word, root) for ``forms`` (word, form): the last word reached by following forms, by pointer doubling.

    A chain of forms has at most ``most_steps`` steps; each round doubles how many are taken.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, most_steps)))):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reached = reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
        reached = written(reached, "roots")
    return reached


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = 7,
    least_times: int = 2,
    times_more: int = 10,
    filter_bytes: int = 16_000_000,
    bits: int = 16,
    words_per_task: int = 40_000,
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of ``least_chars`` letters found ``least_times`` times.

    Words are runs of letters with A-Z lower-cased (``count_words`` says which lose a letter). Two words are near if one
    inserted, deleted or replaced letter makes one the other. A word's form is its near word of largest n, the smallest in
    code-point order of several, if that n is ``times_more`` times its own; its root is where following forms ends, itself
    without a form. All edits of the vocabulary are probed against blocked Bloom filters, one for each word length, of at
    most ``filter_bytes`` together (a larger vocabulary takes more rounds, never a fuller filter); only edits that pass are
    shuffled, to the join with the vocabulary that drops the false ones.

    Null and empty texts have no words; a null id counts as the empty string; repeated rows count again; other columns are
    not read; an empty table gives no rows. ``times_more`` is 2 at least, so that chains of forms end.
    """
    if times_more < 2:
        raise ValueError("a form must be found more often than the word")
    counted = count_words(docs, id_col, text_col, least_chars, least_times)
    vocabulary = written(counted.withColumn("chars", F.length("word")), "vocabulary")
    pairs = near_words(vocabulary, filter_bytes, bits, words_per_task)
    both = F.explode(
        F.array(
            F.struct(F.col("word"), F.col("n"), F.col("other"), F.col("other_n")),
            F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
        )
    ).alias("side")
    more = F.col("other_n") >= F.col("n") * times_more
    best = F.min(F.when(more, F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))))
    chosen = pairs.select(both).select("side.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = vocabulary.select("word", "n").join(chosen, "word", "left")
    forms = written(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.col("best.form").alias("form"),
            (-F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    most, least = forms.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most / least, times_more)) + 1 if most else 0  # n grows times_more-fold with each step
    roots = roots_of(forms.where(F.col("form").isNotNull()), steps)
    rooted = forms.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
