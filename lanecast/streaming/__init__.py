from .feed import append_base, read_order_feed

__all__ = ["append_base", "read_order_feed"]
