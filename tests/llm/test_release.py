"""Models that are destroyed and models that are released."""

from crawlmill.llm.common import broadcast_model, destroy_model, release_models


def test_a_destroyed_model_is_not_released_again(spark):
    kept, gone = broadcast_model(spark, [1]), broadcast_model(spark, [2])
    destroy_model(gone)
    release_models()
    assert kept.value == [1]
