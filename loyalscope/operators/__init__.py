"""DataFrame -> DataFrame building blocks.

``tagging``    rating filters and the reviews-to-users join
``cells``      base cells, GROUPING SETS rollups, segment labels
``trend``      monthly counts, trend windows, endpoints, intervals
``benchmark``  overall and peer-group comparisons
``drivers``    below-overall scoring, top-k ranking, coverage of the top segments
``text``       detractor word counts and lift
``recovery``   tier transitions between a user's consecutive reviews
``checks``     input constraint checks
"""
