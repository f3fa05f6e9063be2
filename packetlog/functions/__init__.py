from .ipaddr import ip_to_long, long_to_ip
from .fields import port_number, shown_interface, trim_host
from .eventtime import syslog_event_time, event_time_before, is_fresh, survives_prune, hours_before

__all__ = ["ip_to_long", "long_to_ip", "port_number", "shown_interface", "trim_host",
           "syslog_event_time", "event_time_before", "is_fresh", "survives_prune", "hours_before"]
