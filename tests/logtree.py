"""A small Spark-on-YARN log tree in a temp folder, for source and end-to-end tests."""

import gzip
import os

C = "1485248649253"
TREE = {
    f"application_{C}_0001/container_{C}_0001_01_000001.log": [
        "17/03/29 10:04:41 INFO ApplicationMaster: Registered signal handlers",
        "17/03/29 10:04:43 INFO YarnAllocator: Will request 2 executor containers, each with 5 cores and 28160 MB memory including 2560 MB overhead",
        "17/03/29 10:05:00 WARN YarnAllocator: Container lost ERROR code",
        "",
        "17/03/29 10:09:59 INFO ApplicationMaster: Final app status: SUCCEEDED",
    ],
    f"application_{C}_0001/container_{C}_0001_01_000002.log": [
        "17/03/29 10:05:01 INFO executor.Executor: Running task 0.0 in stage 0.0 (TID 0)",
        "17/03/29 10:05:09 INFO executor.Executor: Finished task 0.0 in stage 0.0 (TID 0). 2271 bytes result sent to driver",
        "17/03/29 10:06:00 ERROR executor.Executor: Exception in task 1.0 in stage 0.0 (TID 1)",
        "java.io.IOException: boom",
        "\tat a.b.C.d(C.java:1)",
        "17/13/40 10:07:00 INFO bad month",
    ],
    f"application_{C}_0002/container_{C}_0002_01_000001.log": [
        "17/03/30 08:00:00 INFO ApplicationMaster: start",
        "INFORMATION without time",
        "17/03/30 08:30:00 INFO ApplicationMaster: end",
    ],
    "application_1440487435730_0039/container_1440487435730_0039_01_000001.log": [
        "15/09/01 18:14:40 INFO ApplicationMaster: start",
        "15/09/01 18:19:50 DEBUG ApplicationMaster: end",
    ],
    "misc/no_app_here.log": ["17/03/29 10:00:00 INFO orphan: x"],
}


def write_tree(root: str) -> str:
    for rel, lines in TREE.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write("\n".join(lines) + "\n")
    with gzip.open(os.path.join(root, "Spark.tar.gz"), "wt") as f:
        f.write("17/03/29 10:00:00 ERROR should never be read\n")
    return root


def all_lines():
    return [(rel, v) for rel, lines in TREE.items() for v in lines]
