"""Data-integrity forensics on Spark: profile a table, find what is wrong with it, and score it."""

__version__ = "0.1.0"


def investigate(df, target=None, row_id=None, **options):
    """See ``lakeassay.plans.investigate.investigate``."""
    from .plans.investigate import investigate as run

    return run(df, target, row_id, **options)


def investigate_file(spark, path, target=None, **options):
    """See ``lakeassay.plans.investigate.investigate_file``."""
    from .plans.investigate import investigate_file as run

    return run(spark, path, target, **options)
