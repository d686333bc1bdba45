"""Registered queries with their SQL twins, by area."""


def all_queries():
    from passagemill.catalog import corpus_queries, evaluation_queries, index_queries

    return {**corpus_queries.QUERIES, **index_queries.QUERIES, **evaluation_queries.QUERIES}
