"""Import every module that registers queries."""


def load() -> None:
    from checks import (  # noqa: F401
        generate_queries,
        io_queries,
        prepare_queries,
        quality_queries,
        run_queries,
        scoring_queries,
        sentence_queries,
        text_queries,
    )
