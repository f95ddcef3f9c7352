"""Fill-in-the-middle forms of texts, made by Arrow's compute functions over whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces_of

#: The marks of the three parts, and white space and its opposite.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def _draws(id_col: str, seed: str) -> list[Column]:
    """Four numbers drawn from the id: the first four groups of eight hex digits of a digest; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def units_of(texts):
    """(units, owners, counts): every unit of the texts in order, the row each belongs to, and how many each row has.

    A unit is a word with the white space before it; white space at the end is a unit of its own. Splitting at words gives
    one gap more than there are words, so word j follows gap j, and the last gap stands alone.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    gap_lists = pc.split_pattern_regex(texts, WORD)
    gaps, owners = pc.list_flatten(gap_lists), pc.list_parent_indices(gap_lists)
    words = pc.list_flatten(pc.split_pattern_regex(texts, GAP))
    words = pc.filter(words, pc.not_equal(words, ""))
    places = pa.array(np.arange(len(gaps)))
    last = pc.add(pc.cumulative_sum(pc.list_value_length(gap_lists).cast(pa.int64())), -1)
    alone = pc.equal(places, pc.take(last, owners))
    word_at = pc.if_else(alone, pa.scalar(None, pa.int64()), pc.subtract(places, owners))
    units = pc.binary_join_element_wise(gaps, pc.fill_null(pc.take(words, word_at), ""), "")
    there = pc.not_equal(units, "")
    units, owners = pc.filter(units, there), pc.filter(owners, there)
    ends = pc.subtract(last, pa.array(np.arange(len(texts))))  # words of the rows up to this one
    last_units = pc.not_equal(pc.take(gaps, last), "").cast(pa.int64())
    counts = pc.add(pc.pairwise_diff(pa.concat_arrays([pa.array([0], pa.int64()), ends]))[1:], last_units)
    return units, owners, counts


def _starts(counts):
    """Where each row's units begin, and one place more for where the last row's end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pa.concat_arrays([pa.array([0], counts.type), pc.cumulative_sum(counts)])


def _remainder(number, parts):
    import pyarrow.compute as pc

    return pc.subtract(number, pc.multiply(pc.divide(number, parts), parts))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "42",
    percent: int = 50,
    suffix_first_percent: int = 80,
    chunk_bytes: int = 4_000_000,
) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output), one for each row of ``docs``.

    A text is cut into n units (a word with the white space before it; white space at the end), and two of the n + 1 places
    between units, drawn from the id, part it into prefix, middle and suffix. ``percent`` of the ids are rearranged, of these
    ``suffix_first_percent`` as ``spm`` (suffix, prefix, middle), the others as ``psm`` (prefix, suffix, middle), each part
    behind its mark. All else is ``plain``: the text itself, with null sizes. An empty or null text, and one that holds a
    mark already, is plain. A null id counts as the empty string; repeated rows and ids each keep their own row and get the
    same places where id and text agree; other columns are not read; an empty table gives no rows. A batch holds
    ``chunk_bytes`` of text, or one longer text.
    """
    shape = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )

    def form_batch(ids, texts, h1, h2, h3, h4):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        units, owners, counts = units_of(texts)
        starts = _starts(counts)
        ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, owners))
        places = pc.add(counts, 1)
        one, two = _remainder(h1, places), _remainder(h2, places)
        first, second = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
        after_first = pc.greater_equal(ordinals, pc.take(first, owners))
        after_second = pc.greater_equal(ordinals, pc.take(second, owners))
        roles = (
            (pc.invert(after_first), first),
            (pc.and_not(after_first, after_second), pc.subtract(second, first)),
            (after_second, pc.subtract(counts, second)),
        )
        prefix, middle, suffix = (
            pc.binary_join(pa.ListArray.from_arrays(_starts(sizes).cast(pa.int32()), pc.filter(units, has)), "") for has, sizes in roles
        )
        plain = pc.or_(
            pc.or_(pc.equal(counts, 0), pc.match_substring_regex(texts, ANY_MARK)),
            pc.greater_equal(_remainder(h3, 100), percent),
        )
        spm = pc.less(_remainder(h4, 100), suffix_first_percent)
        form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
        output = pc.if_else(
            plain,
            texts,
            pc.if_else(
                spm,
                pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
                pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
            ),
        )
        none = pa.scalar(None, pa.int64())
        sizes = [pc.if_else(plain, none, pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
        return pa.RecordBatch.from_arrays([ids, counts, form, *sizes, output], names=shape.names)

    def run(batches):
        import pyarrow.compute as pc

        for piece in pieces_of(batches, text_col, chunk_bytes):
            whole = [piece.column(k).combine_chunks() for k in range(piece.num_columns)]
            yield form_batch(whole[0], pc.fill_null(whole[1], ""), *whole[2:])

    return docs.select(id_col, text_col, *_draws(id_col, seed)).mapInArrow(run, shape)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of ``fill_in_middle``: the parts between the marks, put back in their order.

    A rearranged text holds no mark of its own, and no mark can begin or end inside another, so cutting at the marks gives
    exactly the parts.
    """
    parts = F.split(output, ANY_MARK, -1)
    prefix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))
