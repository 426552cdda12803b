"""Operators over large collections of molecular structures, as Spark DataFrames.

Every table is keyed by ``structure_id`` (or ``traj_id``, ``msa_id``,
``grid_id``, ``volume_id``), so one call answers for the whole collection.
"""
