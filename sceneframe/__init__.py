"""sceneframe: Spark jobs over large catalogs of media projects."""

__version__ = "0.1.0"
