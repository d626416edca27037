"""DataFrame-in / DataFrame-out operators.

* :mod:`cleaning`  staging -> clean star (copy, standardise, rename, dedup, row hash)
* :mod:`quality`   NULL audit, key and duplicate checks, validation, outliers
* :mod:`analytics` population, late payments, discounts, lifecycle, geography, trends
* :mod:`dated`     facts laid out by date
* :mod:`rescue`    text that does not parse, kept beside the row
* :mod:`marts`     dashboard tables
* :mod:`joins`     pair-free join building blocks shared by the above
"""

from regilens.operators import analytics, cleaning, joins, marts, quality

__all__ = ["analytics", "cleaning", "joins", "marts", "quality"]
