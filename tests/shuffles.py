"""What a job writes for shuffles, as Spark counts it."""


def shuffled(spark, run):
    """Rows and bytes."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        each = [found.apply(i) for i in range(found.size())]
        return {s.stageId(): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in each}

    last = max(stages(), default=-1)
    run()
    return tuple(sum(x) for x in zip(*(n for stage, n in stages().items() if stage > last), strict=True))
