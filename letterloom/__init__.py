"""letterloom: messages, threads, calendar events and contacts as Spark jobs."""
