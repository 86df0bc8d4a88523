"""From inputs to notes in one plan: texts, segments, entries with vectors, references, notes in the wanted forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import lifecycle, memory, render, search, split
from quire.sources import documents
from quire.sources.files import write_notes


@dataclass
class Pipeline:
    """The parts that are given from outside, and the sizes. Without ``embed`` segments get no references."""

    embed: Callable[[list[str]], list[list[float]]] | None = None
    dim: int = 64
    chunk: int = split.CHUNK
    overlap: int = split.OVERLAP
    references: int = 3
    min_similarity: float = 0.6
    now: float = 0.0
    read_pdf: Callable | None = None
    read_image: Callable | None = None
    fetch: Callable | None = None

    def segments(self, texts: DataFrame) -> DataFrame:
        """Segments of texts (note, text) with ids: doc_id, seg_no, id, text. Null and empty texts have none."""
        cut = split.split_texts(texts, "note", "text", self.chunk, self.overlap).withColumnRenamed("note", "doc_id")
        kept = cut.where(F.length(F.trim("text")) > 0)
        return kept.withColumn("id", lifecycle.entry_id("doc_id", "seg_no", "text"))

    def entries(self, segments: DataFrame) -> DataFrame:
        """Long-term entries of segments, with their places and their vectors, null where the provider gives none."""
        added = lifecycle.added_segments(segments, self.now, "generated", ("doc_id", "seg_no"))
        return documents.embedded(added, "text", self.embed, self.dim).drop("error")

    def augmented(self, segments: DataFrame, entries: DataFrame) -> DataFrame:
        """Segments with references to similar ones below them: doc_id, seg_no, id, text.

        A segment asks with the mean of its own vector and those of its neighbours in the note. Texts
        are met with their references by note, and told apart by a digest before.
        """
        if self.embed is None:
            return segments
        own = entries.select("doc_id", "seg_no", F.unhex("id").alias("id"), F.unhex(F.md5("text")).alias("digest"), "embedding")
        near = memory.neighbour_context(own, "doc_id", "seg_no", "embedding").where("embedding is not null")
        most, note = 2 * self.references, segments.schema["doc_id"].dataType.simpleString()
        sides = {"rows": (["embedding"], ["id", "digest"]), "asked": (["embedding", "before", "after"], ["doc_id", "seg_no", "id", "digest"])}
        packed = search.packs(near, sides)
        hits = search.pack_hits(packed, f"doc_id {note}, seg_no int, id binary, digest binary", "id: binary, digest: binary", most, least=self.min_similarity)
        others = F.slice(F.filter("hits", lambda x: (x["digest"] != F.col("digest")) & (x["similarity"] >= self.min_similarity)), 1, self.references)
        lines = F.array_join(F.transform(others, lambda x: memory.reference(F.lower(F.hex(x["id"])), x["similarity"])), "\n")
        found = hits.select("doc_id", F.struct("seg_no", "id", lines.alias("lines")).alias("ref")).where("ref.lines != ''")
        by_note = found.groupBy("doc_id").agg(F.collect_list("ref").alias("refs"))
        mine = F.get(F.filter("refs", lambda x: (x["seg_no"] == F.col("seg_no")) & (x["id"] == F.unhex("id"))), 0)["lines"]
        text = F.concat("text", F.coalesce(F.concat(F.lit("\n\n"), mine), F.lit("")))
        return segments.join(by_note, "doc_id", "left").withColumn("text", text).select("doc_id", "seg_no", "id", "text")

    def notes(self, segments: DataFrame) -> DataFrame:
        """Each note's segments as one text: note, n_segments, text."""
        return render.merge_notes(segments, "doc_id", "seg_no", "text").withColumnRenamed("doc_id", "note")

    def generate(self, texts: DataFrame, formats: list[str] | None = None) -> dict[str, DataFrame]:
        """Notes of texts (note, text) by form: note and text. Unknown forms are left out; none left means Markdown."""
        cut = self.segments(texts)
        notes = self.notes(self.augmented(cut, self.entries(cut)))
        title = render.title_of(F.regexp_extract("note", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))
        out = {}
        for form in render.output_formats(formats or []):
            if form == "markdown":
                made = render.apply_template(title, F.col("text"), F.col("note"), F.from_unixtime(F.lit(self.now)))
                out[form] = notes.select("note", made.alias("text"))
            elif form == "ipynb":
                out[form] = render.render(notes, "note", "text", "notebook").withColumnRenamed("notebook", "text")
            else:
                # no engine writes PDF here: its text stands for it
                out[form] = notes.select("note", render.plain_note(title, "text").alias("text"))
        return out

    def run(self, spark: SparkSession, root: str, target: str, formats: list[str] | None = None) -> DataFrame:
        """All inputs below ``root`` as notes below ``target``, a folder for each form; what could not be read: source, error."""
        read = documents.ingest(spark, root, self.read_pdf, self.fetch, self.read_image)
        made = self.generate(read.where("error is null").select(F.col("source").alias("note"), "text"), formats)
        for form, notes in made.items():
            write_notes(notes, f"{target}/{form}")
        return read.where("error is not null").select("source", "error")

