"""pixelframe: Spark-native analysis of encoded images, measurement reports and training corpora."""

__version__ = "0.1.0"
