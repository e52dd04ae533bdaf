"""Registry of speech corpora, routing of archive members, and quota filters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ranges
from .tables import write_csv

# Corpora by name; whether they are large, and whether they are got by hand.
AUTOMATIC = [
    "alcaim", "brspeech_df", "certas_palavras", "cml_tts", "colingpb", "common_voice", "coraa",
    "gneutral", "mlaad", "nurcsp", "sotaque_brasileiro", "tagarela", "yodas",
]
LARGE = ["alcaim", "cml_tts", "common_voice", "coraa", "nurcsp", "tagarela"]
MANUAL = ["fakebraccent", "braccent", "nurc_rj", "ynoguti", "lasas", "blizzard2027"]


def registry(spark: SparkSession) -> DataFrame:
    rows = [(n, n in LARGE, False) for n in AUTOMATIC] + [(n, False, True) for n in MANUAL]
    return spark.createDataFrame(rows, "name string, large boolean, manual boolean")


def members(rows: DataFrame, name: str = "name") -> DataFrame:
    """Parts of member names ``Name_M001/M001-0012.wav``: dir, gender, speaker, sentence, kind."""
    pattern = r"(?i)^(?:.*/)?([^/]+)_([MF])([0-9]{3})/\2\3-([0-9]{4})\.(wav|txt)$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return rows.withColumns(
        {
            "person": part(1),
            "gender": F.upper(part(2)),
            "speaker": F.upper(F.concat(part(2), part(3))),
            "sentence": part(4).cast("int"),
            "kind": F.lower(part(5)),
        }
    ).where("person IS NOT NULL")


def quota(rows: DataFrame, seq: str, per_speaker: int | None, speakers: int | None, by_gender: bool) -> DataFrame:
    """Members of the first ``speakers`` speakers (half of each gender if asked), and of each
    at most ``per_speaker`` wav members; other members always pass."""
    from ..operators.selection import balanced_keys, cap_per_key, first_keys

    if speakers:
        if by_gender:
            keep = balanced_keys(rows, "speaker", "gender", seq, speakers, 2)
        else:
            keep = first_keys(rows, "speaker", seq, speakers)
        rows = rows.join(keep.select("speaker"), "speaker", "left_semi")
    if not per_speaker:
        return rows
    wav = F.col("kind") == "wav"
    return cap_per_key(rows.where(wav), "speaker", [seq], per_speaker).unionByName(rows.where(~wav))


def clip_index(rows: DataFrame, variant: str | None) -> DataFrame:
    """(path, client_id) of clips: blank or equal variants, the last row of a path."""
    from ..operators.selection import last_wins

    kept = rows
    if variant is not None:
        own = F.trim(F.coalesce("variant", F.lit("")))
        kept = rows.where((own == "") | (own == variant))
    return last_wins(kept.select("path", "client_id", "seq"), "path", ["seq"]).drop("seq")


# ---- names of archive members -------------------------------------------------------

#: Patterns of names.
CORAL_FILE = r"_CO_(.+)\.wav$"
TED_FILE = r"^([A-Za-z0-9_\-]+)-\d+\.wav$"
EPISODE_IN_PATH = r"/([A-Za-z0-9]{22})_[0-9a-f]{40}_"
EPISODE_ID = r"\b([A-Za-z0-9]{22})\b"


def _parts(name: Column) -> Column:
    """Parts of a relative path; empty and dot parts count for nothing."""
    return F.filter(F.split(name, "/"), lambda p: (p != "") & (p != "."))


def route_subsets(rows: DataFrame, name: str = "name") -> DataFrame:
    """subset, speaker and file of members of a corpus of three subsets, told by their second
    part: sessions (speaker is the fourth of five parts), and two kinds of flat folders whose
    file names hold the speaker. Other members have nulls."""
    p = _parts(F.col(name))
    part = lambda i: F.get(p, F.lit(i))
    found = lambda pattern: F.nullif(F.regexp_extract(part(2), pattern, 1), F.lit(""))
    cell = lambda subset, speaker, file: F.struct(
        F.lit(subset).alias("subset"), speaker.alias("speaker"), file.alias("file")
    )
    routed = (
        F.when(~F.col(name).endswith(".wav") | (F.size(p) < 3), None)
        .when((part(1) == "NURC_RE") & (F.size(p) == 5), cell("nurc", part(3), part(4)))
        .when((part(1) == "CORAL") & found(CORAL_FILE).isNotNull(), cell("coral", found(CORAL_FILE), part(2)))
        .when(part(1).startswith("Ted_part") & found(TED_FILE).isNotNull(), cell("ted", found(TED_FILE), part(2)))
    )
    return rows.withColumn("route", routed).select(*rows.columns, "route.subset", "route.speaker", "route.file")


def route_splits(rows: DataFrame, splits: list[str] | None = None, name: str = "name") -> DataFrame:
    """split, speaker and file of members root/split/audio/speaker/chapter/file.wav, of the
    wanted splits; other members go."""
    p = _parts(F.col(name))
    part = lambda i: F.get(p, F.lit(i))
    fits = (F.size(p) >= 6) & F.col(name).endswith(".wav") & (part(2) == "audio")
    if splits:
        fits = fits & part(1).isin(splits)
    return rows.where(fits).withColumns({"split": part(1), "speaker": part(3), "file": part(5)})


def stem_speaker(path: Column) -> Column:
    """Speaker of a file: its stem up to the first ``_``."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.substring_index(stem, "_", 1)


def episode_of(path: Column, pattern: str = EPISODE_IN_PATH) -> Column:
    """Episode id in a path, or null."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def clip_speakers(archive: DataFrame, index: DataFrame, keep: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Members whose file is in the clip index (path, client_id), with their speaker; only
    those of the speakers in ``keep`` (client_id) if given."""
    found = archive.withColumn("path", F.substring_index(name, "/", -1)).join(index.select("path", "client_id"), "path")
    if keep is not None:
        found = found.join(keep.select("client_id"), "client_id", "left_semi")
    return found


def frequent_speakers(index: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(client_id, n) of speakers with ``least`` clips; of these the ``most`` with the most clips."""
    counts = index.groupBy("client_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "client_id").limit(most) if most else counts


def cap_episodes(rows: DataFrame, order: list[str], per_episode: int | None = None, episodes: int | None = None,
                 targets: list[str] | None = None) -> DataFrame:
    """Rows (episode, ...) of the first ``episodes`` episodes in the given order, and of each the
    first ``per_episode``; rows without an episode go."""
    from ..operators.selection import cap_per_key, first_keys

    rows = rows.where("episode IS NOT NULL")
    if targets is not None:
        rows = rows.where(F.col("episode").isin(targets))
    if episodes:
        seq = rows.select("episode", F.struct(*order).alias("seq"))
        rows = rows.join(first_keys(seq, "episode", "seq", episodes).select("episode"), "episode", "left_semi")
    return cap_per_key(rows, "episode", order, per_episode) if per_episode else rows


def choose_members(rows: DataFrame, speakers: set[str] | None = None, genders: set[str] | None = None,
                   sentences: set[int] | None = None, texts: bool = True) -> DataFrame:
    """Members (person, gender, sentence, kind) on the allow-lists; sentences count from 0."""
    if speakers is not None:
        rows = rows.where(F.col("person").isin(sorted(speakers)))
    if genders is not None:
        rows = rows.where(F.col("gender").isin(sorted(genders)))
    if sentences is not None:
        rows = rows.where(F.col("sentence").isin(sorted(sentences)))
    return rows if texts else rows.where("kind <> 'txt'")


def split_rows(splits: dict[str, DataFrame], shard: str, order: list[str]) -> DataFrame:
    """Rows of several splits with their split, place i in it (by shard, then order), and file
    name split_000000. Rows are numbered within shards and raised by the shards before, of
    which there are few."""
    out = None
    for name, rows in splits.items():
        sizes = rows.groupBy(shard).agg(F.count("*").alias("__n"))
        before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        w = Window.partitionBy(shard).orderBy(*order)
        part = rows.withColumn("__r", F.row_number().over(w)).join(sizes, shard)
        part = part.select(F.lit(name).alias("split"), *rows.columns, (F.col("__before") + F.col("__r") - 1).alias("i"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("file", numbered("split", "i", 6))


def numbered(name: str, number: str, width: int) -> Column:
    """``name_0007``"""
    return F.concat_ws("_", F.col(name), F.lpad(F.col(number).cast("string"), width, "0"))


# ---- what users ask for ---------------------------------------------------------------


def _spec(spec: str) -> str:
    if not spec.startswith("@"):
        return spec
    with open(spec[1:], encoding="utf-8") as file:
        return file.read()


def parse_sentence_spec(spec: str, sentences: DataFrame | None = None) -> set[int] | None:
    """0-based places of ``all`` (None), ``balanced50``, ``balanced:k``, ``1-50``, ``1,7 9`` or ``@file``.

    Balanced specs need the sentences (sentence_id from 1, text).
    """
    spec = spec.strip()
    if spec in ("", "all"):
        return None
    if spec.startswith("balanced"):
        from ..operators.sentences import balanced_subset

        k = int(spec.removeprefix("balanced").lstrip(":"))
        return {r["sentence_id"] - 1 for r in balanced_subset(sentences, "sentence_id", "text", k).collect()}
    return {i for lo, hi in ranges(_spec(spec)) for i in range(lo, hi)}


def parse_speakers(spec: str | None) -> set[str] | None:
    """Names between white space or commas, from ``@file`` if so; None for all."""
    return {t for t in re.split(r"[\s,]+", _spec(spec)) if t} if spec else None


def parse_episodes(spec: str | None) -> set[str] | None:
    """Ids of 22 characters in a text or ``@file``; None for all, an error if there are none."""
    if not spec:
        return None
    found = set(re.findall(EPISODE_ID, _spec(spec)))
    if not found:
        raise ValueError("no episode ids of 22 characters")
    return found


# ---- files of a corpus ------------------------------------------------------------------


def local_inputs(spark: SparkSession, archive: str, split: str) -> tuple[DataFrame, list[str]]:
    """(transcript rows, archives) of a corpus tarball: its member ``<split>.tsv``, an error if there is none."""
    import csv
    import io
    import tarfile

    with tarfile.open(archive, "r:*") as tar:
        member = next((m for m in tar if m.name.endswith(f"/{split}.tsv")), None)
        if member is None:
            raise FileNotFoundError(f"{archive} has no {split}.tsv")
        text = tar.extractfile(member).read().decode("utf-8")
    lines = list(csv.reader(io.StringIO(text), delimiter="\t", quoting=csv.QUOTE_NONE))
    head = lines[0]
    rows = [(seq, *[*line, *[None] * len(head)][: len(head)]) for seq, line in enumerate(lines[1:])]
    # A transcript file fits the driver; its clips don't, and stay in the archive.
    return spark.createDataFrame(rows, "seq long, " + ", ".join(f"`{c}` string" for c in head)), [archive]


def split_metadata(spark: SparkSession, base: str, kinds: list[str], splits: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Rows of the files base/kind/audios_split_metadata.csv with kind and split, and the names
    of those that are not there."""
    import glob

    out, missing = None, []
    for kind in kinds:
        for split in splits:
            path = f"{base}/{kind}/audios_{split}_metadata.csv"
            if not glob.glob(path):
                missing.append(path)
                continue
            rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
            rows = rows.select(F.lit(kind).alias("kind"), F.lit(split).alias("split"), *rows.columns)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, missing


def list_files(spark: SparkSession, directory: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """(path, size) of files below one prefix of a tree, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = files.option("pathGlobFilter", f"*{suffix}").load(f"{directory}/{prefix}")
    return files.select("path", F.col("length").alias("size"))


def tree_summary(files: DataFrame) -> DataFrame:
    """One row (n_dirs, n_files, bytes) of files (path, size)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.agg(F.count_distinct(folder).alias("n_dirs"), F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def latest_asset(releases: DataFrame, suffix: str = ".zip", tag: str | None = None) -> DataFrame:
    """(tag, url, size): the first asset with the suffix in a listing (JSON array, newest first)
    in column ``value``; of the named release if given."""
    shape = "array<struct<tag_name:string,assets:array<struct<name:string,browser_download_url:string,size:long>>>>"
    found = releases.select(F.posexplode(F.from_json("value", shape)).alias("r", "release"))
    if tag is not None:
        found = found.where(F.col("release.tag_name") == tag)
    assets = found.select("r", F.col("release.tag_name").alias("tag"), F.posexplode("release.assets").alias("a", "asset"))
    wanted = assets.where(F.col("asset.name").endswith(suffix)).orderBy("r", "a").limit(1)
    return wanted.select("tag", F.col("asset.browser_download_url").alias("url"), F.col("asset.size").alias("size"))


# ---- sinks ----------------------------------------------------------------------------


def with_texts(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows (sentence_id, ...) with the sentence's text, '' if there is none of that number."""
    return rows.join(sentences.select("sentence_id", "text"), "sentence_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def metadata(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """filename, speaker, gender, sentence_id, text of rows that lack the text."""
    return with_texts(rows, sentences).select("filename", "speaker", "gender", "sentence_id", "text")


def write_metadata(rows: DataFrame, sentences: DataFrame, path: str) -> None:
    """The same as CSV, in order of file names."""
    write_csv(metadata(rows, sentences), path, ["filename", "speaker", "gender", "sentence_id", "text"], ["filename"])


def write_corpus_metadata(rows: DataFrame, path: str) -> None:
    """filename, speaker_name, text as CSV."""
    write_csv(rows, path, ["filename", "speaker_name", "text"], ["filename"])


def write_tree(rows: DataFrame, base: str, folder: str = "speaker", file: str = "file", content: str = "content") -> DataFrame:
    """Writes each row's content to base/folder/file through the engine's file system, each file by
    the task that has its row; files of the same size are left. (folder, n, written, bytes) of each folder.

    ``base`` is a folder that all executors share.
    """
    from pyarrow import fs

    def run(batches):
        system, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            out = []
            for name, where, data in zip(batch[folder], batch[file], batch[content], strict=True):
                path = f"{root}/{name}/{where}"
                info = system.get_file_info(path)
                same = info.type == fs.FileType.File and info.size == len(data)
                if not same:
                    system.create_dir(f"{root}/{name}", recursive=True)
                    with system.open_output_stream(path) as stream:
                        stream.write(data)
                out.append((name, int(not same), len(data)))
            yield pd.DataFrame(out, columns=["folder", "written", "bytes"])

    done = rows.select(folder, file, content).mapInPandas(run, "folder string, written long, bytes long")
    return done.groupBy("folder").agg(F.count("*").alias("n"), F.sum("written").alias("written"), F.sum("bytes").alias("bytes"))


def write_wavs(rows: DataFrame, base: str, rate: int = 16000) -> DataFrame:
    """Samples of rows (speaker, file, samples) as 16-bit wave files in the speakers' folders."""
    from .audio import encode_wav

    @F.pandas_udf("binary")
    def coded(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: encode_wav(x, rate))

    return write_tree(rows.withColumn("content", coded("samples")), base)


def class_tree(rows: DataFrame, by: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows with the folder of their class (a safe name of the value of ``by``; blank values go), and (class, n) of the
    classes that have fewer than ``least`` rows and are left out."""
    from ..operators.selection import class_counts, group_key, safe_name

    named = rows.withColumn("class", group_key(F.col(by))).where("class IS NOT NULL")
    counts = class_counts(rows, by)
    kept = named.join(counts.where(F.col("n") >= least).select("class"), "class", "left_semi")
    return kept.withColumn("folder", safe_name(F.col("class"))), counts.where(F.col("n") < least)


def write_class_tree(rows: DataFrame, by: str, base: str, least: int = 1) -> DataFrame:
    """Rows (by, file, content) as files in one folder a class; the dropped classes are given back."""
    kept, dropped = class_tree(rows, by, least)
    write_tree(kept, base, "folder").collect()  # one row a class
    return dropped
