"""phytoscape: community-ecology analytics and survey-data preparation on Spark.

Communities are held in long form ``(site, species, abundance)``; measures are
Catalyst expressions, pairwise measures are equi-joins over shared keys, and
the few dense numerical steps are Arrow-backed kernels on bounded groups.
"""

__version__ = "0.1.0"
