"""Relational operators over utterances, hypotheses, alignments, grids, scores and timings."""
