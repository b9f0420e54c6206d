"""The content tree: building it from posts, articles and pages, and rendering it. Plain Python over one document; ``columns`` puts it on DataFrames."""
