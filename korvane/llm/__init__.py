"""Training-data operators: fixity, packing, licences, vectors, suffix arrays, toxicity, near copies, media, lines, BPE, spelling, alignment, token counts."""
