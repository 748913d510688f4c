"""Table layouts of the engine."""

from __future__ import annotations

POINTS = "series_id string, pos bigint, y bigint"
#: ``ys`` are the (shifted) values, from which native code computes residuals with the decoder's own expression.
RAW_FRAGMENTS = "series_id string, chunk_id bigint, frag_id int, start bigint, len int, model tinyint, plan_bpc tinyint, s bigint, t0 double, t1 double, t2 double, shift bigint, ys array<bigint>"
#: ``residuals``: ``len`` numbers of ``bpc`` bits, most significant bit first, without gaps; null in lossy fragments.
FRAGMENTS = "series_id string, chunk_id bigint, frag_id int, start bigint, len int, model tinyint, bpc tinyint, s bigint, t0 double, t1 double, t2 double, shift bigint, residuals binary"
BLOCKS = "series_id string, block_id bigint, n int, codec string, payload binary, size_bits bigint"

# Tags of the four function families.
LINEAR, EXPONENTIAL, QUADRATIC, SQRT = 0, 1, 2, 3
FAMILIES = {"linear": LINEAR, "exponential": EXPONENTIAL, "quadratic": QUADRATIC, "sqrt": SQRT}
