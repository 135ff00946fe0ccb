"""mmCIF files of a folder, each parsed once for all the categories that are wanted.

Spark's binary reader lists and reads the files, so any store that Spark reaches will do and no list of
paths passes through the driver. A file is one row of an Arrow batch of bounded size; what it gives are rows
(file, category, row, cells), which are written by category, so each table is then a scan of its own part.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.shared import bounded_batches, shared_folder
from strandline.sources.text_formats import cif_tokens

#: Columns of the categories that structures and their bonds are made of.
STRUCTURE = {
    "atom_site": [
        "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z",
        "occupancy", "pdbx_formal_charge", "B_iso_or_equiv", "auth_seq_id", "auth_comp_id", "auth_asym_id", "pdbx_PDB_model_num",
    ],
    "struct_conn": [
        "id", "conn_type_id", "ptnr1_label_asym_id", "ptnr1_label_comp_id", "ptnr1_label_seq_id", "ptnr1_label_atom_id", "pdbx_ptnr1_label_alt_id", "pdbx_ptnr1_PDB_ins_code", "ptnr1_symmetry",
        "ptnr1_auth_asym_id", "ptnr1_auth_comp_id", "ptnr1_auth_seq_id", "ptnr2_label_asym_id", "ptnr2_label_comp_id", "ptnr2_label_seq_id", "ptnr2_label_atom_id", "pdbx_ptnr2_label_alt_id",
        "pdbx_ptnr2_PDB_ins_code", "ptnr2_symmetry", "ptnr2_auth_asym_id", "ptnr2_auth_comp_id", "ptnr2_auth_seq_id",
    ],
    "chem_comp": ["id", "type"],
    "chem_comp_bond": ["comp_id", "atom_id_1", "atom_id_2", "value_order"],
    "entity_poly": ["entity_id", "type"],
    "entity_poly_seq": ["entity_id", "num", "mon_id"],
}

_ROWS = pa.schema([("file", pa.string()), ("category", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
#: Rows of an output batch.
_BATCH = 20_000
#: Data blocks of a file of `write_blocks`.
BLOCKS = 64


def cif_categories(text: str | list[tuple[str, bool]], wanted: dict[str, list[str]]) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Categories of the text, or of its tokens, with the wanted columns of their rows, in one pass; a column that the file lacks is None."""
    single: dict[str, dict[str, str]] = {}
    head: list[tuple[str, str]] = []
    values: list[str] = []
    mode, pending = "", None

    def table() -> tuple[str, list[list[str | None]]] | None:
        category = head[0][0] if head else ""
        if category not in wanted or not values:
            return None
        names = [name for _, name in head]
        at, n = [names.index(c) if c in names else None for c in wanted[category]], len(names)
        return category, [[None if k is None else values[i + k] for k in at] for i in range(0, len(values) - n + 1, n)]

    for token, quoted in cif_tokens(text) if isinstance(text, str) else text:
        name = not quoted and token.startswith("_")
        if not quoted and (token == "loop_" or token.startswith("data_")):
            if mode == "values" and (found := table()):
                yield found
            mode, pending, head, values = ("head" if token == "loop_" else ""), None, [], []
        elif name and mode == "head":
            head.append(tuple(token[1:].partition(".")[::2]))
        elif name:
            if mode == "values" and (found := table()):
                yield found
            mode, pending, head, values = "", token, [], []
        elif mode in ("head", "values"):
            mode = "values"
            if head and head[0][0] in wanted:
                values.append(token)
        elif pending is not None:
            category, _, column = pending[1:].partition(".")
            if category in wanted:
                single.setdefault(category, {})[column] = token
            pending = None
    if mode == "values" and (found := table()):
        yield found
    for category, cells in single.items():
        yield category, [[cells.get(c) for c in wanted[category]]]


def cif_blocks(text: str, wanted: dict[str, list[str]]) -> Iterator[tuple[str, str, list[list[str | None]]]]:
    """Name of the data block with each of its categories; only one block's tokens are held."""
    block, tokens = "", []
    for token, quoted in cif_tokens(text):
        if not quoted and token.startswith("data_"):
            yield from ((block, *found) for found in cif_categories(tokens, wanted))
            block, tokens = token.removeprefix("data_"), []
        else:
            tokens.append((token, quoted))
    yield from ((block, *found) for found in cif_categories(tokens, wanted))


def read_categories(spark: SparkSession, path: str, categories: dict[str, list[str]] | None = None, glob: str = "*.cif*", by_block: bool = False) -> DataFrame:
    """file, category, row, cells (in the order of the category's columns) of all files below path whose names match.

    by_block: of files with several data blocks, each block is a file of its own, named by the path, # and the block.
    """
    wanted = STRUCTURE if categories is None else categories
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode()
                found = ((f"{file}#{block}", *c) for block, *c in cif_blocks(text, wanted)) if by_block else ((file, *c) for c in cif_categories(text, wanted))
                for name, category, rows in found:
                    for k in range(0, len(rows), _BATCH):
                        part = rows[k : k + _BATCH]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([category] * len(part)), pa.array(range(k, k + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], schema=_ROWS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, "file string, category string, row long, cells array<string>")


def tables(spark: SparkSession, path: str, categories: dict[str, list[str]] | None = None, glob: str = "*.cif*", by_block: bool = False) -> dict[str, DataFrame]:
    """A table for each category: file, row, and its columns as text. The files are parsed once, here."""
    wanted = STRUCTURE if categories is None else categories
    folder = shared_folder(spark, "mmcif")
    read_categories(spark, path, wanted, glob, by_block).write.partitionBy("category").parquet(folder)
    tagged = spark.read.schema("file string, row long, cells array<string>, category string").parquet(folder)
    return {name: tagged.where(F.col("category") == name).select("file", "row", *[F.get("cells", i).alias(c) for i, c in enumerate(columns)]) for name, columns in wanted.items()}


def _cell(name: str) -> Column:
    """A value as it stands in a loop: bare, in quotes, or as a text field of its own lines."""
    c = F.col(name).cast("string")
    field = F.concat(F.lit("\n;"), c, F.lit("\n;\n"))
    quoted = F.when(c.contains("\n") | (c.contains("'") & c.contains('"')), field).when(c.contains("'"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    bare = c.rlike(r"""^[^\s'"_#$;\[\]][^\s'"]*$""") & ~F.lower(c).rlike("^(loop_|stop_|global_|data_|save_)")
    return F.when(c.isNull(), "?").when(bare, c).otherwise(quoted)


def cif_text(tables: dict[str, tuple[DataFrame, list[str]]], file: str = "file", row: str = "row") -> DataFrame:
    """file, value: mmCIF text of each file, from tables by category with the columns to write, in the order of row.

    The rows of a file are put together, as they make one file.
    """
    lines = None
    for place, (category, (df, columns)) in enumerate(tables.items()):
        head = "loop_\n" + "".join(f"_{category}.{c}\n" for c in columns)
        part = df.select(F.col(file).cast("string").alias("file"), F.lit(place).alias("place"), F.col(row).cast("long").alias("row"), F.concat_ws(" ", *[_cell(c) for c in columns]).alias("line"))
        first = part.select("file", "place", F.lit(None).cast("long").alias("row"), F.lit(head).alias("line")).distinct()
        part = first.unionByName(part.withColumn("line", F.concat("line", F.lit("\n"))))
        lines = part if lines is None else lines.unionByName(part)
    rows = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "row", "line"))).alias("l"))
    return rows.select("file", F.concat(F.lit("data_"), F.regexp_replace("file", r"\s", "_"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("#\n")).alias("value"))


def write_cif(text: DataFrame, path: str) -> None:
    """One file (file, value) below path/file=... for each row."""
    text.select("file", "value").write.partitionBy("file").text(path)


def write_blocks(text: DataFrame, path: str, most: int = BLOCKS) -> None:
    """The same texts as data blocks of files of at most `most` each, as a file, a folder and their commit cost more than a small structure. Read by block."""
    text.select("value").write.option("maxRecordsPerFile", most).text(path)
