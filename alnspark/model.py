"""Schemas and constants of the alignment model."""

from __future__ import annotations

ALIGNMENTS = (
    "aln_idx long, qname string, flag int, ref_id int, pos int, mapq int, cigar string, rnext int, pnext int, "
    "tlen int, seq string, qual string, md string, opt array<struct<tag:string,type:string,value:string>>"
)
REFERENCES = "ref_id int, name string, length long, seq string"

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800

#: Field groups of a projection mask.
MASK_SEQ, MASK_FLAGS, MASK_READ_IDS, MASK_QUALS, MASK_OPT = 1, 2, 4, 8, 16
MASK_COLUMNS = {
    MASK_SEQ: ["ref_id", "pos", "cigar", "seq", "md"],
    MASK_FLAGS: ["flag", "mapq", "rnext", "pnext", "tlen"],
    MASK_READ_IDS: ["qname"],
    MASK_QUALS: ["qual"],
    MASK_OPT: ["opt"],
}
