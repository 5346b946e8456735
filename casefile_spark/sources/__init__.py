from . import catalogues, cells, eventlog, files, messages, pages, sinks

__all__ = ["catalogues", "cells", "eventlog", "files", "messages", "pages", "sinks"]
