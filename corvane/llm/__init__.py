"""Operations of a training-data pipeline, as Spark jobs over `documents`-shaped tables.

Nothing else in the library imports this subpackage.
"""
