"""Categories by vector similarity, collections of that name, and key-phrase tags."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.functions.phrases import phrase_words, phrases_of, picked_phrases
from foliant.functions.text import filled, or_empty, strip_ws
from foliant.operators.dedupe import skip_processed
from foliant.operators.numbering import with_new_ids
from foliant.session import ship_package, written

THRESHOLD = 0.35
TAG_COUNT = 5
DIVERSITY = 0.5
#: Documents and categories compared at once inside a task.
ROWS, BLOCK = 1024, 4096
#: Bytes of category vectors that are sent to the tasks at once.
CATEGORY_BYTES = 1 << 28
#: Bytes of words and phrases that a Python worker is sent at once, whatever the length of the texts.
TEXT_BYTES = 8 << 20


def similarity_join(documents: DataFrame, categories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, category_id, similarity) of unit vectors whose dot product reaches the threshold.

    Each task compares its documents with blocks of categories. Categories up to ``CATEGORY_BYTES`` are sent to all
    tasks at once; a longer table takes one scan of the documents for every such part of it, whose matches are stored before
    the next part is sent. Rows without a vector match nothing; a vector of another width than the categories' is an
    error, in either table.
    """
    known = categories.where(F.col("embedding").isNotNull()).select("category_id", "embedding")
    size = known.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if size["n"] and size["least"] != size["most"]:
        raise ValueError(f"category vectors have {size['least']} to {size['most']} components")
    width = size["most"] or 0
    parts = -(-size["n"] * width * 8 // CATEGORY_BYTES) or 1
    if parts == 1:
        return _compared(documents, known, width, threshold)
    share = F.pmod(F.xxhash64("category_id"), F.lit(2 * parts))  # half full on average
    found = [_compared(documents, known.where(share == k), width, threshold) for k in range(2 * parts)]
    kept = found if documents.isStreaming else [written(f, "matches") for f in found]
    return reduce(DataFrame.unionByName, kept)


def _compared(documents: DataFrame, categories: DataFrame, width: int, threshold: float) -> DataFrame:
    rows = categories.orderBy("category_id").collect()  # at most CATEGORY_BYTES
    names = np.array([r.category_id for r in rows], dtype=np.int64)
    matrix = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), width)
    shared = documents.sparkSession.sparkContext.broadcast((names, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            own = values.astype(np.float64).reshape(batch.num_rows, width)
            for at in range(0, len(own), ROWS):
                for start in range(0, len(ids), BLOCK):
                    found = own[at : at + ROWS] @ vectors[start : start + BLOCK].T
                    row, col = np.nonzero(found >= threshold)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(at + row)), pa.array(ids[start + col]), pa.array(found[row, col])],
                        names=["id", "category_id", "similarity"],
                    )

    wrong = F.raise_error(F.concat(F.lit("vector width is not that of the categories: "), F.size("embedding").cast("string")))
    checked = F.when(F.size("embedding") == width, F.col("embedding")).otherwise(wrong)
    usable = documents.where(F.col("embedding").isNotNull()) if len(rows) else documents.limit(0)
    return usable.select("id", checked.alias("embedding")).mapInArrow(score, "id BIGINT, category_id BIGINT, similarity DOUBLE")


def category_text(categories: DataFrame) -> DataFrame:
    text = F.coalesce(filled(strip_ws(F.col("description"))), F.col("name"))
    return categories.withColumn("text", text)


def document_text(papers: DataFrame) -> DataFrame:
    """Text a paper is categorised by; papers without any are skipped."""
    text = strip_ws(F.concat(or_empty(F.col("title")), F.lit(" "), or_empty(F.col("abstract"))))
    return papers.select("id", text.alias("text")).where("text <> ''")


def embed_text(documents: DataFrame, dim: int = 256, column: str = "text") -> DataFrame:
    """Unit vectors of texts from hashed and weighted word counts. The words are split and counted once and stored: weights need all counts first."""
    words = RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
    counts = written(hashed.transform(words.transform(documents)).select(*documents.columns, "_counts"), "word-counts")
    stages = [IDF(inputCol="_counts", outputCol="_weighted"), Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0)]
    unit = Pipeline(stages=stages).fit(counts).transform(counts)
    return unit.select(*documents.columns, vector_to_array("_unit", "float32").alias("embedding"))


def root_collections(collections: DataFrame) -> DataFrame:
    """The first root collection of each name: (name, collection_id)."""
    roots = collections.where(F.col("parent_id").isNull())
    return roots.groupBy("name").agg(F.min("id").alias("collection_id"))


def ensure_collections(collections: DataFrame, names: DataFrame) -> DataFrame:
    """Collections with a root for every name; missing ones get the next ids in name order."""
    missing = names.select("name").distinct().join(root_collections(collections), "name", "left_anti")
    new = with_new_ids(missing, collections, [F.col("name")])
    rows = new.select("id", "name", F.lit(None).cast("bigint").alias("parent_id"))
    return collections.select("id", "name", "parent_id").unionByName(rows)


def assign_collections(matches: DataFrame, categories: DataFrame, collections: DataFrame) -> DataFrame:
    """(id, collection_ids) of matched documents. ``collections`` must hold a root for each category name."""
    targets = categories.select("category_id", "name").join(root_collections(collections), "name")
    named = matches.select("id", "category_id").join(targets, "category_id")
    return named.groupBy("id").agg(F.array_sort(F.collect_set("collection_id")).alias("collection_ids"))


def candidate_phrases(papers: DataFrame) -> DataFrame:
    words = papers.select("id", phrase_words(F.col("abstract")).alias("words"))
    return words.withColumn("phrases", phrases_of(F.col("words")))


def mmr_tags(papers: DataFrame, top_n: int = TAG_COUNT, diversity: float = DIVERSITY) -> DataFrame:
    """(id, tags): key phrases of the abstract. Works row by row, so nothing is shuffled; batches are bounded in bytes."""
    spark = papers.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    schema = StructType([papers.schema["id"], StructField("tags", ArrayType(StringType()))])
    return candidate_phrases(papers).select("id", "words", "phrases").mapInArrow(picked_phrases(top_n, diversity), schema)


def united(old: Column, new: Column) -> Column:
    """Set union in a stable order; what the user put there is never removed."""
    return F.array_sort(F.array_union(old, F.coalesce(new, F.array().cast("array<string>"))))


def apply_categories(papers: DataFrame, assigned: DataFrame, tags: DataFrame | None, now: str) -> DataFrame:
    """Merge collections and tags into papers; only papers that change get a new time."""
    rows = papers.join(assigned.select("id", F.col("collection_ids").alias("_c")), "id", "left")
    if tags is None:
        rows = rows.withColumn("_t", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(tags.select("id", F.col("tags").alias("_t")), "id", "left")
    no_ids = F.array().cast("array<bigint>")
    ids = F.array_sort(F.array_union("collection_ids", F.coalesce("_c", no_ids)))
    all_tags = united(F.col("tags"), F.col("_t"))
    changed = (F.size(F.array_except(ids, "collection_ids")) > 0) | (F.size(F.array_except(all_tags, "tags")) > 0)
    return rows.withColumns(
        {
            "collection_ids": F.when(changed, ids).otherwise(F.col("collection_ids")),
            "tags": F.when(changed, all_tags).otherwise(F.col("tags")),
            "date_modified": F.when(changed, F.lit(now)).otherwise(F.col("date_modified")),
        }
    ).select(*papers.columns)


def primary_category(matches: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, name) of the first matched category in category order."""
    first = matches.groupBy("id").agg(F.min("category_id").alias("category_id"))
    return first.join(categories.select("category_id", "name"), "category_id").select("id", "name")


def recategorise(
    papers: DataFrame,
    embeddings: DataFrame,
    categories: DataFrame,
    collections: DataFrame,
    now: str,
    processed: DataFrame | None = None,
    threshold: float = THRESHOLD,
    with_tags: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Categorise the papers that were not handled before. Gives the new papers and the new collections."""
    todo = papers if processed is None else skip_processed(papers, processed, "id", "id")
    matches = similarity_join(embeddings.join(todo.select("id"), "id", "left_semi"), categories, threshold)
    used = categories.join(matches.select("category_id").distinct(), "category_id", "left_semi")
    tree = ensure_collections(collections, used)
    tags = mmr_tags(todo) if with_tags else None
    return apply_categories(papers, assign_collections(matches, categories, tree), tags, now), tree
