"""Schemas of the relations that operators take and return."""

from __future__ import annotations

ALIGNMENTS = "rname string, pos bigint, cigar string, seq string, flag int, tags map<string,string>"
READS = "cell_id string, umi string, clone_id string"
MOLECULES = "cell_id string, umi string, clone_id string, read_count bigint"
CELL_CLONES = "cell_id string, clone_id string, count bigint, ord bigint"
RECORDS = ALIGNMENTS + ", ref int, place bigint, record binary"
