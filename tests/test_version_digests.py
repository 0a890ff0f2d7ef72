"""The first version of a digest comes from a window, so that versions meet their digests once."""

from waymark.jobs import version_queries


def test_versions_meet_their_digests_once(spark, sf_dir):
    plan = version_queries.version_digests(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1
