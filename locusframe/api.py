"""One function for each command line task, under short names.

Every function takes and gives DataFrames; readers and writers are in
``locusframe.sources``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import seq as _seq
from .operators import conservation as _cons
from .operators import coverage as _cov
from .operators import intervals as _iv
from .operators import kmers as _km
from .operators import motif as _mo
from .operators import projection as _pr
from .operators import records as _rec
from .operators import scoring as _sc
from .operators import simulate as _sim
from .operators import stats as _st
from .querylang import search as motif_search  # noqa: F401
from .sources import sequences as _src

# Order, filters, extraction.
sort_alignments = _rec.sort_alignments
check_sorted = _rec.order_violations
filter_fragments = _rec.filter_fragments
filter_records = _rec.filter_records
filter_by_score = _rec.best_score
filter_matching = _rec.matching_rows
extract_fastq = _rec.extract_reads
truncate = _rec.truncate
rejoin = _rec.rejoin
deal = _rec.deal
interleave = _rec.interleave
seqindex = _rec.zip_records
multi_join = _rec.multi_join
index_collisions = _rec.key_collisions

# Projection.
tx2genome = _pr.tx2genome
projection_header = _pr.projection_header
tx_sequence = _pr.transcript_sequences
region_sequences = _pr.region_sequences
collapse_introns = _pr.collapse_introns
meta_exons = _pr.meta_exons

# Scores.
score = _sc.score_fragments
score_calibration = _sc.calibrate
strata = _sc.strata

# Depth.
jumps = _cov.jumps
accuracy = _cov.accuracy_summary
accuracy_bins = _cov.accuracy_bins


def coverage(changes: DataFrame, assert_unique: bool = False) -> DataFrame:
    """One row per covered base; with ``assert_unique``, more correct than guide depth is an error when read."""
    bases = _cov.coverage_bases(_cov.integrate(changes))
    if not assert_unique:
        return bases
    return bases.withColumn("correct", F.when(F.col("correct") > F.col("guide"), F.raise_error(F.lit("correct above guide depth")).cast("long")).otherwise(F.col("correct")))


def mask(changes: DataFrame, min_correct: float = 0.9, max_error: float = 0.1) -> DataFrame:
    """Regions under the guide with too little correct or too much wrong depth."""
    bad = (F.col("guide") > 0) & ((F.col("correct") < min_correct * F.col("guide")) | (F.col("error") > max_error * F.col("guide")))
    return _cov.mask_regions(_cov.integrate(changes), bad)


def depth_stats(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(histogram of depth triples, loci by share of the guide's depth)."""
    runs = _cov.integrate(changes)
    return _cov.depth_histogram(runs), _cov.guide_fractions(runs)


# Intervals.
def union_regions(df: DataFrame, keys: Sequence[str] = ("contig",)) -> tuple[DataFrame, DataFrame]:
    """(islands, island of each interval)."""
    return _iv.islands(df, keys), _iv.with_island(df, keys)


annotate_regions = _iv.annotate
associate_regions = _iv.associate
gaps = _iv.gaps
uncovered_regions = _iv.uncovered
peaks = _iv.peaks

# Sequences.
nmer_spectrum = _km.pair_spectrum
kmer_index = _km.write_index
fasta_header = _src.sequence_header
linear_fasta = _src.linear_fasta


def fastq2fastq(reads: DataFrame, to_offset: int) -> DataFrame:
    """Reads with qualities moved to the offset 33 or 64; the one they have is told from the lowest code of all."""
    lowest = reads.agg(F.min(_seq.lowest_quality(F.col("q")))).first()[0]
    now = 33 if lowest is not None and lowest < 59 else 64
    return reads if now == to_offset else reads.withColumn("q", _seq.shift_quality(F.col("q"), to_offset - now))


def fastq_type(reads: DataFrame) -> DataFrame:
    """Lowest and highest quality code, and the offset that they tell."""
    got = reads.agg(F.min(_seq.lowest_quality(F.col("q"))).alias("lowest"), F.max(_seq.highest_quality(F.col("q"))).alias("highest"))
    return got.withColumn("offset", _seq.quality_offset(F.col("lowest")))


# Statistics.
count_cube = _st.count_cube
marginals = _st.marginals
scatter_smoothing = _st.smooth_sd
pileup_histogram = _st.truncated_histogram
filter_pileup = _rec.pileup_filter

# Motifs, conservation, simulation.
pwm_hits = _mo.matrix_hits
conservation = _cons.conservation
sim_expression = _sim.expression_levels
sim_reads = _sim.read_pairs
