"""The word-level flow: timed words and chapters to sentences, placed chapters and documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from talkloom.operators import paper_edit, render, timeline
from talkloom.scratch import materialise


@dataclass(frozen=True)
class Finalised:
    """Sentence tables of all transcripts; texts are rendered from `words` on demand."""

    words: DataFrame
    sentences: DataFrame
    chapters: DataFrame
    placed: DataFrame

    def transcript(self, per_line: bool = True) -> DataFrame:
        return render.render_sentences(self.words, self.sentences, self.placed, per_line)

    def paper_edit(self) -> DataFrame:
        paragraphs = materialise(paper_edit.dpe_paragraphs(self.sentences, self.chapters, self.placed), "paragraphs")
        return paper_edit.dpe_document(paper_edit.dpe_words(self.words), paragraphs)


def finalise(words: DataFrame, chapters: DataFrame, diarize: bool = True) -> Finalised:
    """Segment, split, repair, snap and place.

    The words are read once for the sentences and once for each rendered document. Sentence and
    chapter tables, which later steps read several times, are written out in between.
    """
    split = materialise(timeline.sentences(timeline.mark_words(words, diarize)), "sentences")
    repaired = materialise(timeline.repair_sentences(split), "repaired")
    snapped = materialise(timeline.snap_chapters(chapters, repaired), "snapped")
    placed = materialise(timeline.place_chapters(snapped, repaired, "sent_no"), "placed")
    return Finalised(words, repaired, snapped, placed)
