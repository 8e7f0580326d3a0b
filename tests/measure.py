"""What Spark's own status store says of the stages so far."""


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    own, jvm, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm, spark.sparkContext._gateway
    own.listenerBus().waitUntilEmpty()
    stages = own.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles."""
    own, jvm, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm, spark.sparkContext._gateway
    own.listenerBus().waitUntilEmpty()
    stages = own.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
