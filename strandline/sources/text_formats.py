"""FASTA, A3M, tab-separated hits, hhr and mmCIF text as DataFrames.

Line formats go through Spark's own text reader. Small files are read whole, so that
their lines keep their order, and records are put together by windows within a file;
`scan_fasta` is for large ones: it splits files at the record mark and needs no window.
mmCIF needs a tokenizer, so it is a Python data source, with several files in a partition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.functions import sequences as S
from strandline.operators import alignment


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files, with whole files as rows, so that a file's lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, record, description, seq."""
    return alignment.fasta_records(read_lines(spark, path), ["file"])


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, place (grows within a file), description, seq of FASTA files of any size, which are split between records."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^>", "").alias("v"))
    lines = F.split("v", "\r?\n")
    kept = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return rows.where("v <> ''").select("file", "place", F.trim(lines[0]).alias("description"), F.array_join(kept, "").alias("seq"))


def read_a3m(spark: SparkSession, path: str, depth: int | None = None, deduplicate: bool = True) -> DataFrame:
    """query (the file), row, description, species, seq; at most depth rows of a file, the first of each aligned sequence."""
    rows = read_fasta(spark, path).select(F.col("file").alias("query"), (F.col("record") - 1).alias("row"), "description", S.species(F.col("description")).alias("species"), "seq")
    if depth is not None:
        rows = rows.where(F.col("row") < depth)
    return alignment.dedup(rows) if deduplicate else rows


def write_a3m(msa: DataFrame, path: str, by_query: bool = False) -> None:
    """Text files of ranges of rows, >description and sequence in the order of query and row; by_query: in a folder for each query.

    A large alignment makes several files, so no task holds it.
    """
    lines = msa.select("query", "row", F.concat(F.lit(">"), "description", F.lit("\n"), "seq").alias("value"))
    lines = lines.repartitionByRange("query", "row").sortWithinPartitions("query", "row")
    if by_query:
        lines.select("query", "value").write.partitionBy("query").text(path)
    else:
        lines.select("value").write.text(path)


def read_hit_table(spark: SparkSession, path: str) -> DataFrame:
    """hit, taxid, pos of a tab-separated file of hits; malformed lines are skipped."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 2).select(parts[0].alias("hit"), parts[1].alias("taxid"), "pos")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index table with all columns as text; entity ids such as 1.0 become 1, what is no number becomes null."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("nullValue", "").csv(path)
    df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    for c in {"entity_1_id", "entity_2_id"} & set(df.columns):
        df = df.withColumn(c, F.col(c).try_cast("double").cast("bigint").cast("string"))
    return df


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """member, cluster_id, cluster_size of a file with one cluster per line; predicted members (AF_, MA_) go."""
    members = F.filter(F.split(F.trim("value"), r"\s+"), lambda m: (m != "") & ~m.startswith("AF_") & ~m.startswith("MA_"))
    rows = spark.read.text(path).select(members.alias("members")).where(F.size("members") > 0)
    return rows.select(F.explode(F.transform("members", F.lower)).alias("member"), F.concat(F.lit("pdb_cluster_"), F.col("members")[0]).alias("cluster_id"), F.size("members").alias("cluster_size"))


def read_hhr(spark: SparkSession, path: str) -> DataFrame:
    """file, number, name, sum_probs, aligned_cols, query_seq, hit_seq of the hits of HHR files."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy("pos")
    lines = read_lines(spark, path).withColumn("hit", F.sum(F.col("line").rlike(r"^No \d+").cast("int")).over(w)).where("hit > 0")
    kind, seq = F.regexp_extract("line", r"^([QT]) (?!ss_|Consensus)\S+\s+\d+ \S+", 1), F.regexp_extract("line", r"^[QT] \S+\s+\d+ (\S+)", 1)
    joined = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == k, F.struct("pos", seq.alias("s"))))), lambda x: x["s"]), "")
    first = lambda pattern: F.max(F.regexp_extract("line", pattern, 1))
    return lines.groupBy("file", "hit").agg(
        first(r"^No (\d+)").cast("int").alias("number"), first(r"^>(.*)").alias("name"), F.max(F.regexp_extract("line", r"Sum_probs=([\d.]+)", 1)).try_cast("double").alias("sum_probs"),
        F.max(F.regexp_extract("line", r"Aligned_cols=(\d+)", 1)).try_cast("int").alias("aligned_cols"), joined("Q").alias("query_seq"), joined("T").alias("hit_seq"),
    )


_TOKEN = re.compile(r"""'(?:[^'\n]|'(?=\S))*'|"(?:[^"\n]|"(?=\S))*"|\#[^\n]*|[^\s]+""")


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Tokens of mmCIF text and whether they were quoted; a text field stands between lines that begin with a semicolon."""
    at_field, field = False, []
    for line in text.splitlines():
        if at_field:
            if line.startswith(";"):
                yield "\n".join(field), True
                at_field, field, line = False, [], line[1:]
            else:
                field.append(line)
                continue
        elif line.startswith(";"):
            at_field, field = True, [line[1:]]
            continue
        for t in _TOKEN.findall(line):
            if t.startswith("#"):
                break
            yield (t[1:-1], True) if t[0] in "'\"" and len(t) > 1 and t[-1] == t[0] else (t, False)


def cif_category(text: str, category: str) -> tuple[list[str], list[list[str]]]:
    """Columns and rows of one category; none if it is missing."""
    prefix = f"_{category}."
    names: list[str] = []
    rows: list[list[str]] = []
    tokens = list(cif_tokens(text))
    i, single = 0, {}
    while i < len(tokens):
        t, quoted = tokens[i]
        if not quoted and t == "loop_":
            i += 1
            head = []
            while i < len(tokens) and not tokens[i][1] and tokens[i][0].startswith("_"):
                head.append(tokens[i][0])
                i += 1
            values = []
            while i < len(tokens) and (tokens[i][1] or not (tokens[i][0].startswith("_") or tokens[i][0] == "loop_" or tokens[i][0].startswith("data_"))):
                values.append(tokens[i][0])
                i += 1
            if head and head[0].startswith(prefix):
                names = [h.removeprefix(prefix) for h in head]
                rows = [values[k : k + len(head)] for k in range(0, len(values) - len(head) + 1, len(head))]
        elif not quoted and t.startswith(prefix) and i + 1 < len(tokens):
            single[t.removeprefix(prefix)] = tokens[i + 1][0]
            i += 2
        else:
            i += 1
    return (list(single), [list(single.values())]) if single and not names else (names, rows)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _open(path: str) -> str:
    import gzip

    from pyarrow import fs as pafs

    path = re.sub("^file:/(?!/)", "/", path)  # Spark's form of local paths
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(inner, compression=None) as f:
        data = f.read()
    return (gzip.decompress(data) if path.endswith(".gz") else data).decode()


class MmcifSource(DataSource):
    """format("mmcif"): rows of one category of mmCIF files, all columns as text.

    Options: path (a file) or paths (a JSON list), category (atom_site by default),
    columns (a JSON list; by default those of the first file that has the category,
    which the driver opens files to find), files (of a partition, 16 by default).
    """

    @classmethod
    def name(cls) -> str:
        return "mmcif"

    def _paths(self) -> list[str]:
        path = self.options.get("path", "")
        return json.loads(self.options["paths"]) if "paths" in self.options else [path] if path else []

    def _category(self) -> str:
        return self.options.get("category", "atom_site")

    def schema(self) -> T.StructType:
        if "columns" in self.options:
            return T.StructType([T.StructField(n, T.StringType()) for n in ["file", *json.loads(self.options["columns"])]])
        for p in self._paths():
            names, _ = cif_category(_open(p), self._category())
            if names:
                return T.StructType([T.StructField(n, T.StringType()) for n in ["file", *names]])
        return T.StructType([T.StructField("file", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MmcifReader(self._paths(), self._category(), schema, int(self.options.get("files", 16)))


class _MmcifReader(DataSourceReader):
    def __init__(self, paths: list[str], category: str, schema: T.StructType, files: int):
        self.paths, self.category, self.names, self.files = paths, category, [f.name for f in schema.fields][1:], files

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.paths[i : i + self.files]) for i in range(0, len(self.paths), self.files)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            names, rows = cif_category(_open(path), self.category)
            at = [names.index(n) if n in names else None for n in self.names]
            for row in rows:
                yield (path, *[None if k is None else row[k] for k in at])


def read_mmcif(spark: SparkSession, paths: list[str], category: str = "atom_site", columns: list[str] | None = None, files: int = 16) -> DataFrame:
    """Rows of a category of the files; with columns given, the driver opens none of them."""
    spark.dataSource.register(MmcifSource)
    reader = spark.read.format("mmcif").option("paths", json.dumps(paths)).option("category", category).option("files", str(files))
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()


def atoms_of(sites: DataFrame, model: int = 1) -> DataFrame:
    """The engine's atom table from atom_site rows: numbers typed, one model, the order of atoms kept."""
    n = lambda c: F.col(c).try_cast("double")
    rows = sites.where(F.col("pdbx_PDB_model_num").cast("int") == model) if "pdbx_PDB_model_num" in sites.columns else sites
    return rows.select(
        F.col("file").alias("pdb_id"), F.col("id").cast("long").alias("atom_idx"), F.col("label_asym_id").alias("chain_id"), F.col("label_entity_id").alias("entity_id"), F.col("label_seq_id").try_cast("int").alias("res_id"),
        F.col("label_comp_id").alias("res_name"), F.col("label_atom_id").alias("atom_name"), F.col("type_symbol").alias("element"), F.col("label_alt_id").alias("alt_id"), n("occupancy").alias("occupancy"),
        n("Cartn_x").alias("x"), n("Cartn_y").alias("y"), n("Cartn_z").alias("z"), F.lit(True).alias("is_resolved"),
    )


def cif_of(atoms: DataFrame) -> DataFrame:
    """mmCIF text of each structure: pdb_id, value. A structure's atoms make one row, as they make one file."""
    q = lambda c: F.when(F.col(c).cast("string").rlike(r"[\s']"), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(".")))
    columns = {"group_PDB": F.lit("ATOM"), "id": q("atom_idx"), "type_symbol": q("element"), "label_atom_id": q("atom_name"), "label_comp_id": q("res_name"), "label_asym_id": q("chain_id"), "label_entity_id": q("entity_id"), "label_seq_id": q("res_id"), "Cartn_x": F.format_string("%.3f", "x"), "Cartn_y": F.format_string("%.3f", "y"), "Cartn_z": F.format_string("%.3f", "z")}
    head = "data_structure\nloop_\n" + "\n".join(f"_atom_site.{c}" for c in columns) + "\n"
    lines = atoms.select("pdb_id", "atom_idx", F.concat_ws(" ", *columns.values()).alias("line"))
    rows = lines.groupBy("pdb_id").agg(F.sort_array(F.collect_list(F.struct("atom_idx", "line"))).alias("l"))
    return rows.select("pdb_id", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n#\n")).alias("value"))
