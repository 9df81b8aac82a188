"""A small language for motif searches: ``key : value`` lines that name patterns and clusters.

::

    # comment
    matrix: ase
    A C G T
    0 -5 -5 -5
    ...
    strand: POS_NEG
    min_score: -10
    total_hits: 1000
    cluster_group: a

    collection: box
    1 GRYNNTCGA
    min_score: -1          # at most one mismatch

    cluster: both
    cluster_type: diversity
    cluster_window: 500
    cluster_min_requirements: 2
    cluster_requirement: a 1
    cluster_requirement: box 2

``parse`` gives the search as data, ``search`` its plan as a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import motif
from .plans.scan import kept

SETTINGS = frozenset(
    "species data_directory merge_overlapping_clusters position_file tree_file dna_index_file hits_file cluster_file ones_offset "
    "max_total_hits max_collection_size max_pwm_length min_pwm_length min_collection_score max_patterns".split()
)


@dataclass
class Pattern:
    name: str
    matrix: list[dict[str, int]] = field(default_factory=list)
    consensus: list[tuple[str, str]] = field(default_factory=list)
    strand: str = "POS_NEG"
    min_score: int = -(1 << 30)
    total_hits: int = 1 << 60
    group: str | None = None


@dataclass
class Cluster:
    name: str
    kind: str = "diversity"
    window: int = 1000
    least: int = 1
    needs: dict[str, int] = field(default_factory=dict)


@dataclass
class Search:
    settings: dict[str, str] = field(default_factory=dict)
    patterns: list[Pattern] = field(default_factory=list)
    clusters: list[Cluster] = field(default_factory=list)


def parse(text: str) -> Search:
    """The search that a text asks for; a ValueError names the line that cannot be read."""
    out = Search()
    rows: list[list[str]] = []

    def finish() -> None:
        if not rows:
            return
        p = out.patterns[-1]
        if rows[0] == list("ACGT"):
            p.matrix = [dict(zip("ACGT", map(int, r), strict=True)) for r in rows[1:]]
        elif rows[0][0].rstrip(":") in "ACGT" and len(rows) == 4:
            by_base = {r[0].rstrip(":"): [int(x) for x in r[1:] if x != ":"] for r in rows}
            p.matrix = [{b: by_base[b][i] for b in "ACGT"} for i in range(len(by_base["A"]))]
        else:
            p.consensus = [(r[0], r[1]) for r in rows]
        rows.clear()

    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        try:
            if not colon or key in ("A", "C", "G", "T"):
                if not out.patterns:
                    raise ValueError("no pattern is open")
                rows.append(line.split())
                continue
            finish()
            if key in ("matrix", "collection"):
                out.patterns.append(Pattern(value))
            elif key == "strand":
                out.patterns[-1].strand = value
            elif key == "min_score":
                out.patterns[-1].min_score = int(value)
            elif key == "total_hits":
                out.patterns[-1].total_hits = int(value)
            elif key == "cluster_group":
                out.patterns[-1].group = value
            elif key == "cluster":
                out.clusters.append(Cluster(value))
            elif key == "cluster_type":
                if value != "diversity":
                    raise ValueError(f"cluster type {value}")
                out.clusters[-1].kind = value
            elif key == "cluster_window":
                out.clusters[-1].window = int(value)
            elif key == "cluster_min_requirements":
                out.clusters[-1].least = int(value)
            elif key == "cluster_requirement":
                name, n = value.split()
                out.clusters[-1].needs[name] = int(n)
            elif key in SETTINGS:
                out.settings[key] = value
            else:
                raise ValueError(f"unknown key {key}")
        except (ValueError, IndexError) as e:
            raise ValueError(f"line {number}: {e}") from e
    finish()
    return out


def pattern_hits(seqs: DataFrame, p: Pattern) -> DataFrame:
    """(id, pos, kmer, strand, score, name) of one pattern, cut to its best score levels."""
    strands = {"POS": "+", "NEG": "-"}.get(p.strand, "+-")
    if p.matrix:
        hits = motif.matrix_hits(seqs, p.matrix, p.min_score, strands)
    else:
        found = motif.consensus_hits(seqs, [c for _, c in p.consensus], -p.min_score, strands)
        hits = found.select("id", "pos", "kmer", "strand", (-F.col("mismatches")).alias("score"))
    hits = hits.withColumn("name", F.lit(p.name)).withColumn("grp", F.lit(p.group or p.name))
    return motif.top_levels(hits, p.total_hits) if p.total_hits < 1 << 60 else hits


def search(seqs: DataFrame, what: Search | str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(hits of all patterns, members of each named cluster)."""
    if isinstance(what, str):
        what = parse(what)
    hits = reduce(DataFrame.unionByName, [pattern_hits(seqs, p) for p in what.patterns])
    located = hits.select(
        F.col("id").alias("contig"), F.xxhash64("id", "pos", "strand", "name").alias("id"), F.col("pos").cast("long").alias("start"), (F.col("pos") + F.length("kmer")).cast("long").alias("stop"), "grp", "name", "strand", "score"
    )
    if what.clusters:
        located = kept(located, "hits")  # each cluster reads them several times
    clusters = {}
    for c in what.clusters:
        clusters[c.name] = motif.cluster_members(located, motif.diversity_windows(located, c.window, c.needs, c.least), c.window)
    return located, clusters
