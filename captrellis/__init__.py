"""Caption-corpus preparation, chat-sample building and caption scoring on Spark."""

__version__ = "0.1.0"
