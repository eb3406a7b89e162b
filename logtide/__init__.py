"""logtide: Spark-native analysis of Spark-on-YARN log trees and timestamped tables."""

__version__ = "0.1.0"
